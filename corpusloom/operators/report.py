"""The document and the JSON record of a run. Only what is shown comes to the driver: what the budget
took, and short lists."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import paths
from ..functions import text as tx


def tier_name(tier: Column) -> Column:
    return F.when(tier == 1, config.TIER_NAMES[1]).when(tier == 2, config.TIER_NAMES[2]).otherwise(config.TIER_NAMES[3])


def tier_label(tier: Column, path: Column) -> Column:
    return F.when(tier == 1, F.when(paths.is_entry(path), "full source").otherwise("structured summary")).when(tier == 2, "signatures").otherwise("one-liner")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """Rows (name, path): each symbol's name and the least path that defines it."""
    return symbols.select(F.btrim("name").alias("name"), "path").where("name <> ''").groupBy("name").agg(F.min("path").alias("path"))


def first_symbols(symbols: DataFrame, ranked: DataFrame, n: int = config.INDEX_SYMBOLS) -> DataFrame:
    """The first ``n`` symbols that are fit to show, over files of tiers 1 and 2 in their order."""
    order = ("tier", F.desc("score"), "path", "pos")
    fit = symbols.where(tx.is_symbol_name(F.col("name"))).join(ranked.where("tier < 3").select("path", "tier", "score"), "path")
    return fit.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # n rows


def statistics(included: DataFrame, total_files: int) -> DataFrame:
    """One row of counts and sums over what was included (tier, token_count)."""
    return included.agg(
        F.lit(total_files).cast("long").alias("total_files"), F.count("*").alias("included_files"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"),
        F.count_if(F.col("tier") == 1).alias("core_count"), F.count_if(F.col("tier") == 2).alias("supporting_count"), F.count_if(F.col("tier") == 3).alias("peripheral_count"),
    )


def savings(files: DataFrame, included: DataFrame) -> DataFrame:
    """One row: files and tokens there are (tokens), those shown (token_count), and what was saved, in
    hundredths."""
    there = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
    shown = included.agg(F.count("*").alias("shown"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("shown_tokens"))
    return there.crossJoin(F.broadcast(shown)).withColumn("saved", F.when(F.col("tokens") > 0, 100 - F.floor(100 * F.col("shown_tokens") / F.col("tokens"))).otherwise(0).cast("long"))  # one row each


def top_folders(included: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` top folders with most files, ties by name; ``.`` for files in the root."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    return included.groupBy(top.alias("folder")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder").limit(n)


def architecture(included: DataFrame, text: str = "") -> str:
    if text:
        spark = included.sparkSession
        short = spark.range(1).select(tx.excerpt(F.lit(text)).alias("t")).first()["t"]
        return short + "\n\n(Architecture truncated. See ARCHITECTURE.md for details.)"
    langs = [r["l"] for r in included.where("language <> 'unknown'").select(F.lower("language").alias("l")).distinct().orderBy("l").limit(2).collect()]
    lines = [f"A {langs[0]}-based project composed of the following subsystems:" if len(langs) == 1 else "A software project composed of the following subsystems:", ""]
    found = top_folders(included).collect()
    lines += [f"- **{r['folder']}/**: Primary subsystem containing {r['files']} files" for r in found if r["folder"] != "."]
    if not included.where(~F.col("path").contains("/")).isEmpty():
        lines.append("- **Root**: Contains scripts and execution points")
    return "\n".join(lines)


def diagram(included: DataFrame, edges: DataFrame, n: int = config.DIAGRAM_NODES) -> str:
    """The best files and the edges among them, as a Mermaid graph."""
    from .graph import top_edges

    fit = included.where(paths.in_diagram(F.col("path"))).select("path", "score")
    top = [r["path"] for r in fit.orderBy(F.desc("score"), "path").limit(n).collect()]
    if not top:
        return "*No dependency data available.*\n\n"
    nodes = ['    f{}["{}"]'.format(i, p.replace('"', '\\"')) for i, p in enumerate(top)]
    links = [f"    f{r['src_id']} --> f{r['dst_id']}" for r in top_edges(fit, edges, n).orderBy("src_id", "dst_id").collect()]
    return "\n".join(["```mermaid", "graph LR", *nodes, *links, "```\n\n"])


def cycles(cyclic: DataFrame, edges: DataFrame) -> str:
    """Circular chains, shorter ones first, and files on cycles too long to be shown as chains."""
    from . import graph

    if cyclic.isEmpty():
        return ""
    chains = [list(r["nodes"]) for r in graph.cycles(edges, cyclic, n=config.DIAGRAM_NODES).collect()]
    shown = {p for c in chains for p in c}
    rest = [r["path"] for r in cyclic.where(~F.col("path").isin(*shown)).orderBy("path").limit(config.DIAGRAM_NODES).collect()] if len(chains) < config.DIAGRAM_NODES else []
    lines = [f"{i}. " + " -> ".join(f"`{p}`" for p in c) for i, c in enumerate(chains, 1)]
    more = ["", "Files on longer chains:", "", *(f"- `{p}`" for p in rest)] if rest else []
    return "\n".join(["### Cyclic Dependencies", "", "> [!WARNING]", "> The following circular import chains were detected:", "", *lines, *more, "", ""])


def symbol_lines(rows: list) -> str:
    """rows: the first symbols in order, with path, kind, name and children."""
    out, last = [], None
    for r in rows:
        if r["path"] != last:
            out += ([""] if last else []) + [f"**`{r['path']}`**"]
            last = r["path"]
        if r["kind"] == "class":
            out += [f"- class `{r['name'].strip()}`", *(f"  - `{c}()`" for c in r["children"])]
        else:
            out.append(f"- `{r['name'].strip()}()`")
    return "\n".join([*out, ""]) if out else "*No symbols found within budget.*\n"


def call_path_lines(found: DataFrame, symbols: DataFrame) -> str:
    """Each path as ``stem.firstSymbol()`` steps."""
    first = symbols.groupBy("path").agg(F.min_by("name", "pos").alias("symbol"))
    steps = found.select("rank", F.posexplode("nodes").alias("i", "path")).join(first, "path", "left")
    shown = F.concat(paths.stem(F.col("path")), F.coalesce(F.concat(F.lit("."), "symbol"), F.lit("")), F.lit("()"))
    lines, last = [], None
    for r in steps.select("rank", "i", shown.alias("s")).orderBy("rank", "i").collect():  # as many as paths and steps are shown
        if last is not None and r["rank"] != last:
            lines.append("")
        lines.append(r["s"] if r["i"] == 0 else f"  → {r['s']}")
        last = r["rank"]
    return "\n".join([*lines, ""]) if lines else "*No call paths detected.*\n\n"


def ranked_table(included: DataFrame, n: int = config.RANKED_ROWS) -> str:
    rows = included.orderBy(F.desc("score"), "path").limit(n)
    line = F.format_string("| `%s` | %.3f | %s | %d |\n", "path", "score", tier_label(F.col("tier"), F.col("path")), "token_count")
    return "| File | Score | Tier | Tokens |\n|------|-------|------|--------|\n" + "".join(r["l"] for r in rows.select(line.alias("l"), "score", "path").orderBy(F.desc("score"), "path").collect()) + "\n"


def sections(included: DataFrame, edges: DataFrame, cyclic: DataFrame, symbols: DataFrame, found_paths: DataFrame, architecture_text: str = "", recent: str = "") -> dict[str, str]:
    """The document's sections in order. ``included``: path, tier, score, language, content,
    token_count of what the budget took; ``symbols``: path, pos, name, kind, children."""
    rows = included.orderBy("tier", F.desc("score"), "path").select("path", "tier", "content").collect()  # the budget bounds these
    entry = set(config.ENTRY_NAMES)
    is_entry = lambda r: r["path"].rsplit("/", 1)[-1] in entry

    def whole(keep, none: str) -> str:
        return "".join(r["content"] + "\n" for r in rows if keep(r)) or none

    shown = first_symbols(symbols, included).orderBy("place").collect()
    body = {
        "architecture": architecture(included, architecture_text) + "\n\n",
        "entry_points": whole(lambda r: r["tier"] == 1 and is_entry(r), "*No entry points identified within budget.*\n\n"),
        "symbol_index": symbol_lines(shown) + "\n",
        "important_call_paths": call_path_lines(found_paths, symbols),
        "core_modules": whole(lambda r: r["tier"] == 1 and not is_entry(r), "*No core modules selected within budget.*\n\n"),
        "supporting_modules": whole(lambda r: r["tier"] == 2, "*No supporting modules selected within budget.*\n\n"),
        "dependency_graph": diagram(included, edges) + cycles(cyclic, edges),
        "ranked_files": ranked_table(included),
        "periphery": "".join(r["content"] for r in rows if r["tier"] == 3) + "\n" if any(r["tier"] == 3 for r in rows) else "*No periphery files selected within budget.*\n\n",
    }
    out = {k: f"## {k.upper()}\n\n{body[k]}" for k in config.SECTIONS}
    return out | ({"recent_changes": f"## RECENT_CHANGES\n\n{recent}\n"} if recent else {})


def write_document(found: dict[str, str], path: str | Path) -> None:
    """Known sections in order, then any others."""
    order = [k for k in config.SECTIONS if k in found] + [k for k in found if k not in config.SECTIONS]
    Path(path).write_text("".join(found[k] for k in order), encoding="utf-8")


def write_layers(found: dict[str, str], folder: str | Path) -> None:
    for name, keys in config.LAYERS.items():
        (Path(folder) / name).write_text("".join(found.get(k, "") for k in keys), encoding="utf-8")


def payload(included: DataFrame, symbols: DataFrame, total_files: int, repository: str, budget: int, generated_at: str, version: str) -> str:
    """The JSON record: files by score, symbol index, counts."""
    files = included.orderBy(F.desc("score"), "path").select("path", tier_name(F.col("tier")).alias("tier"), F.col("token_count").alias("tokens"), F.round("score", 6).alias("rank_score"), tx.summary_line(F.col("content")).alias("summary"), F.lit(True).alias("included"))
    index = {r["name"]: r["path"] for r in symbol_index(symbols.join(included.select("path"), "path", "left_semi")).orderBy("name").collect()}  # of files that the budget took
    stats = statistics(included, total_files).first().asDict()
    return json.dumps({"version": version, "generated_at": generated_at, "repository": repository, "budget_tokens": budget, "files": [r.asDict() for r in files.collect()], "symbol_index": index, "stats": stats}, indent=2)
