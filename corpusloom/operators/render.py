"""What a file shows in each tier: its source, a structured summary, its signatures, or one line."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import paths
from ..functions import text as tx

#: Fixed values: (modules, classes, methods, functions, with docs, with notes) shown, from most to least.
SUMMARY_SIZES = ((8, 6, 6, 12, True, True), (6, 4, 4, 8, True, True), (6, 3, 4, 8, False, True), (5, 2, 3, 6, False, False), (4, 1, 2, 4, False, False))
SHOWN_CONSTANTS = 20
#: Double-underscore methods that a summary names.
SHOWN_DUNDERS = ("__init__", "__call__", "__str__", "__repr__")


def _fence(language: Column) -> Column:
    return F.concat(F.lit("```"), F.when(language == "unknown", F.lit("")).otherwise(language))


def _heading(path: Column) -> Column:
    return F.format_string("### `%s`\n", path)


def source(path: Column, language: Column, text: Column) -> Column:
    """The whole file; an entry file up to its line limit."""
    lines = F.split(text, "\n")
    n = config.ENTRY_LINES
    cut = F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit(f"\n\n... (truncated: entry point exceeds {n} lines)"))
    shown = F.when(paths.is_entry(path) & (F.size(lines) > n), cut).otherwise(text)
    return F.concat(_heading(path), F.lit("\n"), _fence(language), F.lit("\n"), shown, F.lit("\n```\n"))


def signatures(path: Column, language: Column, docstrings: Column, symbols: Column, imports: Column, lines: Column) -> Column:
    doc = F.when(F.size(docstrings) > 0, F.format_string("> %s\n", F.get(docstrings, F.lit(0))))
    each = F.transform(symbols, lambda s: F.concat(s["signature"], F.when(s["docstring"] != "", F.concat(F.lit('\n    """'), s["docstring"], F.lit('"""'))).otherwise(""), F.lit("\n")))
    listed = F.concat_ws("\n", _fence(language), F.array_join(each, "\n"), F.lit("```\n"))
    none = F.format_string("*%d lines, %d imports*\n", lines, F.size(imports))
    return F.concat_ws("\n", _heading(path), doc, F.when(F.size(symbols) > 0, listed).otherwise(none))


def kind_counts(kinds: Column) -> Column:
    """``1 class, 3 functions`` of an array of kinds, in their order by name."""
    def one(k: Column) -> Column:
        n = F.size(F.filter(kinds, lambda x: x == k))
        return F.concat(n.cast("string"), F.lit(" "), k, F.when(n > 1, F.lit("s")).otherwise(""))

    return F.array_join(F.transform(F.array_sort(F.array_distinct(kinds)), one), ", ")


def one_liner(docstrings: Column, symbols: Column, imports: Column, lines: Column) -> Column:
    """The first docstring's first line, 80 letters; else counts."""
    kinds = F.when(F.size(symbols) > 0, kind_counts(F.transform(symbols, lambda s: s["kind"])))
    counts = F.concat_ws(", ", kinds, F.when(F.size(imports) > 0, F.format_string("%d imports", F.size(imports))), F.format_string("%d lines", lines))
    return F.when(F.size(docstrings) > 0, F.left(tx.first_line(F.get(docstrings, F.lit(0))), F.lit(80))).otherwise(counts)


def notes(partial: Column, symbols: Column, text: Column, lines: Column) -> Column:
    """What stands out in a file, as an array."""
    spread = F.flatten(F.transform(symbols, lambda s: F.concat(F.array(s["signature"]), F.coalesce(F.transform(s["children"], lambda c: c["signature"]), F.array().cast("array<string>")))))
    n_async = F.size(F.filter(spread, lambda s: F.ltrim(s).startswith("async ")))
    n_deco = F.size(F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t")).startswith("@")))
    return F.filter(
        F.array(
            F.when(partial, F.lit("partial parse")),
            F.when(n_async > 2, F.format_string("async-heavy (%d async functions)", n_async)),
            F.when(n_deco > 5, F.format_string("decorator-heavy (%d decorators)", n_deco)),
            F.when(lines > config.ENTRY_LINES, F.format_string("large file (%d lines)", lines)),
        ),
        lambda x: x.isNotNull(),
    )


def _package(path: Column) -> tuple[Column, Column, Column]:
    """(package, its folder, the file's folders within it): the first folder that is an identifier, below
    ``src`` if the file is there; null if there is none."""
    parts = paths.parts(path)
    skip = F.when(F.startswith(path, F.lit("src/")), 1).otherwise(0)
    name = F.get(parts, skip)
    name = F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), name)
    return name, paths.joined(F.slice(parts, F.lit(1), skip + 1)), F.slice(parts, skip + 2, F.greatest(F.size(parts) - skip - 2, F.lit(0)))


def module_candidates(text: Column, path: Column) -> Column:
    """Modules of a file's own package that an import of it may mean, without the package's name."""
    package, _, within = _package(path)
    line = F.btrim(F.regexp_replace(text, r"\s+", " "))
    none = F.array().cast("array<string>")
    bare = lambda x: F.btrim(F.substring_index(F.btrim(x, F.lit("() ")), " as ", 1))
    inside = lambda m: F.when(m.startswith(F.concat(package, F.lit("."))), F.substring(m, F.length(package) + 2, F.length(m)))
    plain = F.filter(F.transform(F.split(F.regexp_extract(line, r"^import (.*)$", 1), ","), lambda x: inside(bare(x))), lambda x: x.isNotNull())
    module, names = F.btrim(F.regexp_extract(line, r"^from (.*?) import (.*)$", 1)), F.regexp_extract(line, r"^from (.*?) import (.*)$", 2)
    # names that may be modules: small letters, digits and underscores
    names = F.filter(F.transform(F.split(names, ","), bare), lambda x: x.rlike(r"^[a-z0-9_]*[a-z0-9][a-z0-9_]*$"))
    below = lambda base: F.concat(F.when(base != "", F.array(base)).otherwise(none), F.transform(names, lambda x: F.when(base != "", F.concat(base, F.lit("."), x)).otherwise(x)))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    up = F.greatest(dots - 1, F.lit(0))
    anchor = F.when(up > F.size(within), none).otherwise(F.slice(within, F.lit(1), F.size(within) - up))
    rest = F.filter(F.split(F.substring(module, dots + 1, F.length(module)), r"\."), lambda x: x != "")
    beside = F.concat(F.when(F.size(rest) > 0, F.array(F.array_join(F.concat(anchor, rest), "."))).otherwise(none), F.transform(names, lambda x: F.array_join(F.concat(anchor, rest, F.array(x)), ".")))
    whole = F.when(module == package, names).otherwise(F.coalesce(below(inside(module)), none))
    out = F.when(line.startswith("import "), plain).when(line.rlike("^from .* import "), F.when(module.startswith("."), beside).otherwise(whole)).otherwise(none)
    return F.when(package.isNull(), none).otherwise(F.array_distinct(F.coalesce(out, none)))


def internal_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (root, path, modules): by name, the modules of its own package that a file's ``imports``
    (root, path, import_text) name and that are among ``files`` (root, path)."""
    _, folder, _ = _package(F.col("path"))
    asked = imports.select("root", "path", folder.alias("_folder"), F.explode(module_candidates(F.col("import_text"), F.col("path"))).alias("module")).distinct()
    base = F.concat("_folder", F.lit("/"), F.replace("module", F.lit("."), F.lit("/")))
    asked = asked.withColumn("file", F.explode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))))
    known = files.select("root", F.col("path").alias("file")).distinct()
    return asked.join(known, ["root", "file"], "left_semi").groupBy("root", "path").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def summarize(path: str, docstrings: list[str], modules: list[str], symbols: list[dict], constants: list[str], noted: list[str], tokens: Callable[[str], int]) -> str:
    """A structured summary of at most so many tokens as is allowed: the fullest size that fits; else
    purpose and first function, if these fit; else the least size."""
    first = lambda s: (s or "").strip().split("\n", 1)[0].strip()
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace("_", " ").strip() or "module"
    purpose = next((first(d) for d in docstrings if d.strip()), "") or f"Implements {stem}."
    head = [f"### `{path}`", "", f"**Purpose:** {purpose}"]
    ranked = sorted(symbols, key=lambda s: (s["kind"], s["name"], s["signature"]))
    classes = [s for s in ranked if s["kind"] == "class"]
    functions = [s for s in ranked if s["kind"] != "class"]

    def class_line(s: dict, limit: int) -> str:
        names = sorted({c["name"] for c in s["children"] or [] if c["name"] and (not c["name"].startswith("_") or c["name"] in SHOWN_DUNDERS)})
        parts = [f"`{s['name']}`"]
        if s["bases"]:
            parts.append(f"(bases: `{s['bases']}`)")
        if doc := first(s["docstring"]):
            parts.append(f"- {doc}")
        if shown := names[:limit]:
            parts.append("methods: " + ", ".join(f"`{m}`" for m in shown) + (f" (+{len(names) - limit} more)" if len(names) > limit else ""))
        return "- " + " ".join(parts)

    def function_lines(s: dict, docs: bool) -> list[str]:
        return [f"- `{s['short'] or s['name']}`"] + ([f"  - {first(s['docstring'])}"] if docs and first(s["docstring"]) else [])

    built = ""
    for n_modules, n_classes, n_methods, n_functions, docs, with_notes in SUMMARY_SIZES:
        out = list(head)
        if modules:
            more = f", +{len(modules) - n_modules} more" if len(modules) > n_modules else ""
            out.append("**Depends on:** " + ", ".join(f"`{m}`" for m in modules[:n_modules]) + more)
        if classes:
            out += ["", "**Types:**", *(class_line(s, n_methods) for s in classes[:n_classes])]
        if functions:
            out += ["", "**Functions:**", *(x for s in functions[:n_functions] for x in function_lines(s, docs))]
        if constants:
            out += ["", "## Constants", *constants[:SHOWN_CONSTANTS]]
        if with_notes and noted:
            out += ["", "**Notes:** " + "; ".join(noted)]
        built = "\n".join([*out, ""])
        if tokens(built) <= config.SUMMARY_TOKENS:
            return built
    least = "\n".join([*head, *(["", "**Functions:**", *function_lines(functions[0], True)] if functions else []), ""])
    return least if tokens(least) <= config.SUMMARY_TOKENS else built


def estimated(text: str) -> int:
    return -(-len(text) // 4)


def contents(files: DataFrame, tokens: Callable[[str], int] = estimated) -> DataFrame:
    """``files`` (parsed, with tier and modules) with ``content`` by tier. Summaries are only made for
    tier 1 files that are no entries, a batch at a time."""
    spread = F.transform("symbols", lambda s: s.withField("bases", tx.bases(s["signature"])).withField("short", tx.short_signature(s["signature"])))
    rows = files.withColumns({"_symbols": spread, "_notes": notes(F.col("partial_parse"), F.col("symbols"), F.col("text"), F.col("line_count"))})

    def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, doc, modules, symbols, constants, noted in zip(*(b.column(c).to_pylist() for c in ("path", "docstrings", "modules", "_symbols", "constants", "_notes")), strict=True):
                out.append(summarize(path, doc, modules or [], symbols or [], constants, noted, tokens))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "content"])

    p, lang = F.col("path"), F.col("language")
    whole = source(p, lang, F.col("text"))
    two = signatures(p, lang, F.col("docstrings"), F.col("symbols"), F.col("imports"), F.col("line_count"))
    three = F.format_string("- `%s` — %s\n", p, one_liner(F.col("docstrings"), F.col("symbols"), F.col("imports"), F.col("line_count")))
    summed = (F.col("tier") == 1) & ~paths.is_entry(p)
    with_, without = rows.where(summed), rows.where(~summed)
    with_ = with_.mapInArrow(summed_up, T.StructType([*with_.schema.fields, T.StructField("content", T.StringType())]))
    without = without.withColumn("content", F.when(F.col("tier") == 1, whole).when(F.col("tier") == 2, two).otherwise(three))
    return with_.unionByName(without).drop("_symbols", "_notes")
