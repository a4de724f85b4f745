"""Texts, as Column expressions."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
#: Identifiers that name no symbol.
KEYWORDS = ("def", "class", "import", "from", "return")
#: Line patterns of imports, by language, for files that could not be parsed.
IMPORT_LINES = {
    "python": r"^\s*import\s+.+$|^\s*from\s+.+\s+import\s+.+$",
    "javascript": r"^\s*import\s+.+$|^\s*const\s+.+\s*=\s*require\(.+\).*$|^\s*require\(.+\).*$",
    "typescript": r"^\s*import\s+.+$|^\s*const\s+.+\s*=\s*require\(.+\).*$|^\s*require\(.+\).*$",
    "go": r'^\s*import\s+\("?.+"?\)?\s*$',
    "rust": r"^\s*use\s+.+;$",
    "java": r"^\s*import\s+.+;$",
}
#: Fixed value: a text between triple quotes that a Python file begins with.
DOCSTRING = r"^\s*(?:'''|\"\"\")([\s\S]*?)(?:'''|\"\"\")"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8; what isn't becomes replacement signs."""
    return F.make_valid_utf8(content.cast("string"))


def is_binary(content: Column) -> Column:
    """A zero byte in the first bytes, or these are not valid UTF-8, as where the last letter is cut."""
    probe = F.substring(content, 1, config.BINARY_PROBE)
    return F.contains(probe, F.lit(bytearray(b"\0"))) | ~F.is_valid_utf8(probe.cast("string"))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def estimated_tokens(text: Column) -> Column:
    """Tokens where no vocabulary is at hand: a quarter of the letters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def truncated(text: Column, tokens: Column) -> Column:
    """As many letters as so many estimated tokens have, and a note."""
    return F.concat(F.left(text, (tokens * 4).cast("int")), F.lit("\n... [truncated to fit token budget]"))


def import_lines(text: Column, language: Column) -> Column:
    """Lines that look like an import of the language, trimmed."""
    lines = F.split(text, r"\r\n|\r|\n")

    def like(pattern: str) -> Column:
        return F.filter(lines, lambda x: x.rlike(pattern))

    out = F.array().cast("array<string>")
    for lang, pattern in IMPORT_LINES.items():
        out = F.when(language == lang, like(pattern)).otherwise(out)
    return F.transform(out, lambda x: F.btrim(x, F.lit(" \t\f\v")))


def module_docstring(text: Column) -> Column:
    """The text between triple quotes that a Python file begins with; null if it doesn't."""
    return F.when(text.rlike(DOCSTRING), F.btrim(F.regexp_extract(text, DOCSTRING, 1), F.lit(" \t\r\n\f")))


def used_names(text: Column) -> Column:
    """Distinct identifiers less keywords."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), 0)), F.array(*map(F.lit, KEYWORDS)))


def is_symbol_name(s: Column) -> Column:
    """Fit for a symbol index: not empty, one line, 100 letters at most."""
    return (F.btrim(s) != "") & ~s.contains("\n") & (F.length(F.btrim(s)) <= 100)


def is_usage_name(s: Column) -> Column:
    return s.rlike("^[A-Za-z_]")


def bases(signature: Column) -> Column:
    """Between the first opening and the last closing parenthesis."""
    return F.btrim(F.regexp_extract(signature, r"^[^(]*\(([\s\S]*)\)", 1))


def short_signature(signature: Column, limit: int = 120) -> Column:
    """A signature of ``limit`` letters at most: parameters are kept whole while they fit."""
    sig = F.replace(F.btrim(signature), F.lit("\n"), F.lit(" "))
    head = F.regexp_extract(sig, r"^([^(]*\()", 1)
    tail = F.regexp_extract(sig, r"^[^(]*\([^)]*(\).*)$", 1)
    inner = F.regexp_extract(sig, r"^[^(]*\(([^)]*)\)", 1)
    params = F.filter(F.transform(F.split(inner, ","), lambda p: F.btrim(p)), lambda p: p != "")
    start = F.struct(head.alias("text"), F.lit(0).alias("i"), F.lit(False).alias("full"))

    def step(acc: Column, p: Column) -> Column:
        chunk = F.concat(F.when(acc["i"] > 0, F.lit(", ")).otherwise(""), p)
        over = F.length(acc["text"]) + F.length(chunk) + F.length(tail) + 4 > limit
        more = F.when(acc["i"] == 0, F.lit("...")).otherwise(", ...")
        return F.when(acc["full"], acc).otherwise(F.struct(F.concat(acc["text"], F.when(over, more).otherwise(chunk)).alias("text"), (acc["i"] + 1).alias("i"), over.alias("full")))

    built = F.aggregate(params, start, step, lambda acc: F.concat(acc["text"], tail))
    return F.when(F.length(sig) <= limit, sig).when(tail == "", F.concat(F.left(sig, F.lit(limit - 3)), F.lit("..."))).otherwise(built)


def excerpt(text: Column, limit: int = 200) -> Column:
    """The first paragraph without headings, as one line of ``limit`` letters at most."""
    lines = F.filter(F.split(F.btrim(text, F.lit(" \t\r\n")), "\n"), lambda x: ~x.startswith("#"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        own = F.btrim(x, F.lit(" \t\r"))
        blank = own == ""
        return F.struct(F.when(acc["over"] | blank, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(own))).alias("kept"), (acc["over"] | (blank & (F.size(acc["kept"]) > 0))).alias("over"))

    return F.left(F.array_join(F.aggregate(lines, start, step, lambda acc: acc["kept"]), " "), F.lit(limit))


def summary_line(content: Column) -> Column:
    """The first line that has text and begins neither a heading nor a code fence."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.coalesce(F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("###") & ~x.startswith("```")), F.lit(0)), F.lit(""))


def parse_since(since: str, now: float) -> float | None:
    """Seconds of ``7 days ago``, of an ISO date, with its offset if it has one and else UTC, or of a
    plain date; None if it is none of these."""
    text = since.strip()
    if m := re.fullmatch(r"(\d+)\s+days?\s+ago", text):
        return now - int(m[1]) * 86400
    try:
        at = datetime.datetime.fromisoformat(text)
    except ValueError:
        return None
    return (at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)).timestamp()
