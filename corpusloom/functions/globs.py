"""Ignore rules as Column predicates: gitignore patterns become anchored regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches a path, with a slash after it if it is a folder's."""

    regex: str
    keep: bool


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """Rules of an ignore file's lines, in order; blank lines and comments say nothing."""
    out = []
    for line in lines:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        keep = text.startswith("!")
        text = text[1:] if keep or text.startswith(("\\#", "\\!")) else text
        folder = text.endswith("/")
        body = text.rstrip("/")
        if not body:
            continue
        anchored = "/" in body
        out.append(Rule(("^" if anchored else "^(?:.*/)?") + _translate(body.lstrip("/")) + ("/$" if folder else "/?$"), keep))
    return out


def _translate(glob: str) -> str:
    """The regular expression of a pattern: * and ? stay within a name, ** spans folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif glob[i] == "*":
            alone = (i == 0 or glob[i - 1] == "/") and (i + 1 == len(glob) or glob[i + 1] == "/")
            out, i = out + ("[^/]+" if alone else "[^/]*"), i + 1
            while i < len(glob) and glob[i] == "*":
                i += 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def decide(path: str, rules: list[Rule]) -> bool:
    """Whether the last rule that matches one path ignores it."""
    return next((not r.keep for r in reversed(rules) if re.match(r.regex, path)), False)


def ignored_path(path: str, rules: list[Rule]) -> bool:
    """Whether a file's path, or a folder on the way to it, is ignored."""
    parts = path.split("/")
    return any(decide("/".join(parts[: i + 1]) + "/", rules) for i in range(len(parts) - 1)) or decide(path, rules)


def ignored(path: Column, rules: list[Rule]) -> Column:
    """``ignored_path`` as a Column: the last rule that matches decides for each folder on the way and
    for the file, and nothing below an ignored folder comes back."""
    parts = F.split(path, "/")
    n = F.size(parts)
    way = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < n, F.lit("/")).otherwise("")))

    def last(p: Column) -> Column:
        return reduce(lambda rest, r: F.when(p.rlike(r.regex), F.lit(not r.keep)).otherwise(rest), rules, F.lit(False))

    return F.exists(way, last)


def matches_any(name: Column, globs: Iterable[str]) -> Column:
    """Whether a name matches one of shell-like patterns, which have no slash."""
    return name.rlike("^(?:" + "|".join(_translate(g) for g in globs) + ")$")


def sensitive(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a pattern matches the file or a folder above it."""
    return ignored(path, parse_rules(patterns))
