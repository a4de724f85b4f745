"""A whole run: source trees to a token-budgeted document, a search, and timings of the stages."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import globs, paths
from ..functions import text as tx
from ..functions import tokens as bpe
from ..operators import budget, extract, graph, rank, render, report, resolve, semantic
from ..sources import cache, repo_files
from ..storage import stored
from .providers import PROVIDERS, Summarizer, summarizer, together

__all__ = ["PROVIDERS", "Stages", "analyze", "benchmark", "manifest_of", "search", "write"]

#: Turns a batch of texts into vectors.
Encoder = Callable[[list[str]], list[list[float]]]


@dataclass
class Stages:
    """The tables of a run, lazily."""

    files: DataFrame
    parsed: DataFrame
    edges: DataFrame
    signals: DataFrame | None = None
    ranked: DataFrame | None = None
    included: DataFrame | None = None
    cyclic: DataFrame | None = None
    roots: list[str] = field(default_factory=list)


def scan(spark: SparkSession, roots: list[str], settings: config.Config) -> DataFrame:
    """Files of all roots but what the run itself writes; those that may hold secrets only if the
    settings ask for them."""
    found = repo_files.files(spark, roots, settings.extra_ignore, settings.output_file)
    if settings.layers:
        found = found.where(~F.col("path").isin(*config.LAYERS))
    return found if settings.include_sensitive else found.where(~globs.sensitive(F.col("path"), config.SENSITIVE))


def labels(roots: list[str]) -> dict[str, str]:
    """What tells the files of several roots apart: the name of each root's folder, with a number where
    two are called the same; none of a single root."""
    out: dict[str, str] = {}
    if len(roots) > 1:
        for r in dict.fromkeys(roots):
            name = own = Path(r).resolve().name or "root"
            n = 1
            while f"@{own}" in out.values():
                n += 1
                own = f"{name}-{n}"
            out[str(r)] = f"@{own}"
    return out


def key(names: dict[str, str], root: Column, path: Column) -> Column:
    """A file's key in a run: its path, below its root's label if there are several."""
    if not names:
        return path
    at = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), root)
    return F.concat(at, F.lit("/"), path)


def keyed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` (root, path) with the key as ``path`` and the path in its root as ``rel``."""
    return rows.withColumns({"rel": F.col("path"), "path": key(names, F.col("root"), F.col("path"))})


def history(spark: SparkSession, roots: list[str], names: dict[str, str], settings: config.Config, since: float | None = None) -> DataFrame:
    """Commits of all roots, by their files' keys."""
    if settings.no_git:
        return spark.createDataFrame([], repo_files.CHANGES)
    logs = [repo_files.commits(spark, r, since=since).withColumn("path", key(names, F.lit(str(r)), F.col("path"))) for r in dict.fromkeys(roots)]
    return reduce(DataFrame.unionByName, logs)


def parse(files: DataFrame, kept: str | None = None) -> DataFrame:
    """Parsed files, from the kept table where path and hash are the same; the table is brought up to
    date."""
    if kept is None:
        return stored(extract.parse(files), "parsed")
    schema = extract.parse(files.limit(0)).schema
    hits, missing = cache.split_by_cache(files, cache.read_table(files.sparkSession, kept, schema))
    done = stored(hits.unionByName(extract.parse(missing)), "parsed")
    cache.replace_table(done, kept)
    return done


def dependencies(parsed: DataFrame, files: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Edges between the keys of files of all roots: imports, and uses of symbols that other files
    define. ``parsed`` and ``files`` have (root, path)."""
    names = names or {}
    imports = parsed.select("root", "path", "language", F.posexplode("imports").alias("pos", "import_text"))
    found = resolve.resolve(imports, files, resolve.go_modules(files), roots=list(names) if len(names) > 1 else None)  # labels keep the order given
    own = keyed(parsed, names)
    refs = resolve.cross_references(extract.symbols(own).where("kind <> 'method'"), extract.usages(own))
    src, dst = key(names, F.col("root"), F.col("path")), key(names, F.col("target_root"), F.col("file"))
    return stored(graph.edges(found.select(src.alias("src"), dst.alias("dst")), refs), "edges")


def signals(parsed: DataFrame, edges: DataFrame, changes: DataFrame, task: str, as_of: float, relevance: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals of each file, nodes on cycles). ``parsed`` is keyed."""
    nodes = parsed.select("path").distinct()
    meta = repo_files.change_stats(changes, parsed.select("path", "mtime"))
    dist = graph.distances(edges, graph.entry_points(nodes, edges))
    cyclic = stored(graph.cyclic(edges), "cyclic")
    days = rank.days_since(F.col("last_modified_ts"), as_of)
    rows = (
        parsed.select("path", F.size("symbols").alias("symbols"), (F.lit(1.0) / (1 + F.size(paths.parts(F.col("rel"))))).alias("depth"))
        .join(meta, "path", "left").join(graph.degrees(nodes, edges).select("path", "fan_in"), "path", "left").join(dist, "path", "left")
        .join(cyclic.withColumn("cyclic", F.lit(True)), "path", "left")
    )
    if relevance is not None:
        rows = rows.join(relevance, "path", "left")
    own = [F.col("relevance")] if relevance is not None else []
    return rows.select("path", F.coalesce("commit_count", F.lit(0)).alias("freq"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"), rank.recency(days, task).alias("recency"), rank.nearness(F.col("dist")).alias("proximity"), "symbols", "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), *own), cyclic


def ranked(parsed: DataFrame, edges: DataFrame, scores: DataFrame, files: DataFrame) -> DataFrame:
    """Files with score, tier and content, before the budget. ``parsed`` is keyed."""
    imported = graph.importers(edges).select("path").distinct().withColumn("imported", F.lit(True))
    rows = parsed.join(scores.select("path", "score"), "path").join(imported, "path", "left")
    rel = F.col("rel")
    low = paths.is_non_source(rel) | paths.is_config(rel, F.coalesce("imported", F.lit(False)))
    tiers = rank.tiers(rows.select("path", "score", low.alias("low")), F.col("low")).select("path", "tier")
    imports = parsed.where("language = 'python'").select("root", F.col("rel").alias("path"), F.explode("imports").alias("import_text"))
    modules = render.internal_modules(imports, files).withColumnRenamed("path", "rel")
    return stored(rows.drop("imported").join(tiers, "path").join(modules, ["root", "rel"], "left"), "ranked")


def include(files: DataFrame, settings: config.Config, summarize: Summarizer | None = None) -> DataFrame:
    """Files that the budget takes, with what they show of themselves. A summarizer rewrites tier 1
    files that are no entries before they are charged. Tokens are those of the settings' vocabulary,
    or estimated."""
    words = settings.vocabulary
    count = (lambda c: bpe.count(words, c)) if words else tx.estimated_tokens
    shown = render.contents(files, bpe.counter(words) if words else render.estimated)
    if summarize is not None:

        @F.pandas_udf("string")
        def rewrite(path: pd.Series, text: pd.Series) -> pd.Series:
            return pd.Series([f"### `{p}`\n\n{told}\n" for p, told in zip(path, together(summarize, path, text), strict=True)])

        own = (F.col("tier") == 1) & ~paths.is_entry(F.col("path"))
        shown = shown.where(~own).unionByName(shown.where(own).withColumn("content", rewrite("path", "text")))
    shown = shown.select("path", "score", "tier", "language", "content")
    # a vocabulary counts in Python, which takes stored columns only
    rows = stored((stored(shown, "shown") if words else shown).withColumn("tokens", count(F.col("content"))), "contents")
    taken = budget.fill(rows, settings.token_budget)
    cut = F.col("charged") < F.col("tokens")
    short = bpe.truncated(words, F.col("content"), F.col("charged")) if words else tx.truncated(F.col("content"), F.col("charged"))
    if words:  # only the one file that is cut goes through Python
        taken = taken.where(~cut).unionByName(taken.where(cut).withColumn("content", short))
    else:
        taken = taken.withColumn("content", F.when(cut, short).otherwise(F.col("content")))
    return stored(taken.withColumn("token_count", count(F.col("content"))), "included")


def relevance(parsed: DataFrame, query: str, encode: Encoder, kept: str | None = None) -> DataFrame:
    """Rows (path, relevance) of files to a query. Vectors are taken from the ``kept`` table where path
    and hash are the same and their length is the encoder's; the table is brought up to date."""
    spark, texts, asked = parsed.sparkSession, semantic.document_text(parsed), encode([query])[0]
    if kept is None:
        vectors = semantic.embed(texts, encode)
    else:
        old = cache.read_table(spark, kept, spark.createDataFrame([], semantic.EMBEDDINGS).schema)
        vectors = stored(semantic.embed(texts, encode, old, len(asked)), "vectors")
        cache.replace_table(vectors, kept)
    return semantic.relevance(vectors, asked).select(F.col("file_path").alias("path"), "relevance")


def analyze(spark: SparkSession, roots: list[str], settings: config.Config, as_of: float | None = None, encode: Encoder | None = None, kept: str | None = None) -> Stages:
    """All stages. ``as_of`` fixes the time that ages are counted from; ``kept`` is the folder of what
    earlier runs parsed and embedded."""
    now, names = time.time() if as_of is None else as_of, labels(roots)
    files = stored(scan(spark, roots, settings), "files")
    plain = parse(files, f"{kept}/parsed" if kept else None)
    edges = dependencies(plain, files, names)
    parsed = keyed(plain, names)
    changes = stored(history(spark, roots, names, settings), "changes")
    near = relevance(parsed, settings.query, encode, f"{kept}/vectors" if kept else None) if settings.query and encode else None
    rows, cyclic = signals(parsed, edges, changes, settings.task, now, near)
    rows = stored(rows, "signals")
    scores = stored(rank.score(rows, settings.task, near is not None), "scores")
    all_ = ranked(parsed, edges, scores, files)
    return Stages(files, parsed, edges, rows, all_, include(all_, settings, summarizer(settings) if settings.llm_enabled else None), cyclic, list(map(str, roots)))


def write(stages: Stages, root: str, settings: config.Config, changes: DataFrame | None = None, as_of: float | None = None) -> str:
    """The document, or the JSON record, of a run; also written to the output file."""
    spark, now = stages.files.sparkSession, time.time() if as_of is None else as_of
    symbols = stages.parsed.select("path", F.posexplode("symbols").alias("pos", "s")).select("path", "pos", "s.name", "s.kind", F.transform("s.children", lambda c: c["name"]).alias("children"))
    out = Path(root, settings.output_file)
    if settings.output_format == "json":
        at = datetime.datetime.fromtimestamp(now, datetime.timezone.utc).isoformat()
        text = report.payload(stages.included, symbols, stages.parsed.count(), str(Path(root).resolve()), settings.token_budget, at, "1")
        out.write_text(text, encoding="utf-8")
        return text
    nodes = stages.parsed.select("path")
    found = graph.call_paths(stages.edges, graph.entry_points(nodes, stages.edges), max_paths=3 if settings.task == "architecture" else 1)
    arch = Path(root, "ARCHITECTURE.md")
    recent = ""
    if settings.since and not settings.no_git and (cutoff := tx.parse_since(settings.since, now)) is not None:
        roots = stages.roots or [root]
        recent = repo_files.recent_changes(history(spark, roots, labels(roots), settings, cutoff) if changes is None else changes, cutoff)
    sections = report.sections(stages.included, stages.edges, stages.cyclic, symbols, found, arch.read_text(encoding="utf-8") if arch.is_file() else "", recent)
    report.write_document(sections, out)
    if settings.layers:
        report.write_layers(sections, root)
    return out.read_text(encoding="utf-8")


def manifest_of(spark: SparkSession, roots: list[str], settings: config.Config) -> dict:
    """What a run would be made of. The output file is never part of it."""
    options = {k: v if not isinstance(v, tuple) else list(v) for k, v in asdict(settings).items() if k not in ("force", "verbose")}
    return cache.manifest(keyed(scan(spark, roots, settings), labels(roots)), options)


def search(spark: SparkSession, roots: list[str], query: str, encode: Encoder, limit: int = 10, settings: config.Config | None = None, kept: str | None = None) -> DataFrame:
    """The files most relevant to a query."""
    parsed = keyed(parse(scan(spark, roots, settings or config.Config()), f"{kept}/parsed" if kept else None), labels(roots))
    return semantic.top(relevance(parsed, query, encode, f"{kept}/vectors" if kept else None), limit, "path")


def benchmark(spark: SparkSession, roots: list[str], settings: config.Config) -> dict[str, float]:
    """Seconds of each stage."""
    took, at, names = {}, time.time(), labels(roots)

    def lap(name: str) -> None:
        nonlocal at
        took[name], at = time.time() - at, time.time()

    files = stored(scan(spark, roots, settings), "files")
    lap("walk")
    plain = parse(files)
    lap("parse")
    edges = dependencies(plain, files, names)
    lap("graph")
    parsed = keyed(plain, names)
    rows, _ = signals(parsed, edges, stored(history(spark, roots, names, settings), "changes"), settings.task, time.time())
    scores = stored(rank.score(stored(rows, "signals"), settings.task), "scores")
    lap("rank")
    include(ranked(parsed, edges, scores, files), settings).count()
    lap("compress")
    return took
