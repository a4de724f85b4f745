"""Paths, as Column expressions. Paths are relative and have slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .globs import matches_any


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def folder(path: Column) -> Column:
    """The folders on the way, as an array."""
    return F.slice(parts(path), 1, F.size(parts(path)) - 1)


def suffix(path: Column) -> Column:
    """From the last dot of the name, if letters come before and after it; else empty."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def joined(segments: Column) -> Column:
    return F.array_join(segments, "/")


def normal(segments: Column) -> Column:
    """Segments without ``.`` and ``..``; null if these lead out of the root."""
    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
        return F.when(acc.isNull() | s.isin("", "."), acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(segments, F.array().cast("array<string>"), step)


def language(path: Column) -> Column:
    """By suffix, capitals told from small letters; ``unknown`` if none has it."""
    own = suffix(path)
    out = F.lit("unknown")
    for lang, suffixes in config.LANGUAGES.items():
        out = F.when(own.isin(*suffixes), F.lit(lang)).otherwise(out)
    return out


def is_entry(path: Column) -> Column:
    return name(path).isin(*config.ENTRY_NAMES)


def is_non_source(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, config.NON_SOURCE_DIRS)))


def is_config(path: Column, imported: Column) -> Column:
    """A known name; or a configuration suffix, where JSON that another file imports is source."""
    own = F.lower(suffix(path))
    return name(path).isin(*config.CONFIG_NAMES) | (own.isin(*config.CONFIG_SUFFIXES) & ~((own == ".json") & imported))


def is_watched(path: Column) -> Column:
    """Folder, then name, then pattern, then suffix."""
    return (
        ~F.arrays_overlap(parts(path), F.array(*map(F.lit, config.WATCH_IGNORED_DIRS)))
        & ~name(path).isin(*config.WATCH_IGNORED_NAMES)
        & ~matches_any(name(path), config.WATCH_IGNORED_GLOBS)
        & F.lower(suffix(path)).isin(*config.WATCH_SUFFIXES)
    )


def in_diagram(path: Column) -> Column:
    return ~F.arrays_overlap(parts(path), F.array(*map(F.lit, config.DIAGRAM_IGNORED_DIRS))) & ~path.endswith(".scm") & ~path.endswith(".md")


def longest_root(path: Column, roots: Column) -> Column:
    """The longest of an array of roots that a path is below, or is; else null."""
    below = F.filter(roots, lambda r: (path == r) | path.startswith(F.concat(F.rtrim(r, F.lit("/")), F.lit("/"))))
    return F.get(F.array_sort(below, lambda a, b: F.length(b) - F.length(a)), F.lit(0))
