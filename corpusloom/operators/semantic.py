"""Similarity of embedded entities to a query, kept embeddings, and their upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import cache

EMBEDDINGS = "file_path string, file_hash string, embedding array<float>"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine, which is held in -1..1; 1 if either has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.greatest(F.least(dot(a, b) / scale, F.lit(1.0)), F.lit(-1.0)))


def relevance(embeddings: DataFrame, query: list[float]) -> DataFrame:
    """``embeddings`` (..., embedding) with ``distance`` and ``relevance``: the distance as a share of
    the largest, from 1, six decimals. The query is a literal; the largest distance is one row."""
    far = embeddings.withColumn("distance", cosine_distance(F.col("embedding"), F.lit([float(x) for x in query])))
    most = far.agg(F.max("distance").alias("_most"))
    share = F.col("distance") / F.when(F.col("_most") == 0, 1.0).otherwise(F.col("_most"))
    return far.crossJoin(F.broadcast(most)).withColumn("relevance", F.round(F.greatest(F.lit(1.0) - share, F.lit(0.0)), 6)).drop("_most")


def top(scored: DataFrame, k: int, key: str) -> DataFrame:
    """The ``k`` most relevant, ties by key, less those of no relevance."""
    return scored.orderBy(F.desc("relevance"), key).limit(k).where("relevance > 0")


def document_text(parsed: DataFrame) -> DataFrame:
    """Rows (file_path, file_hash, text) of parsed files: names and docstrings of symbols, docstrings
    of the file; its name if it has none."""
    own = F.flatten(F.transform("symbols", lambda s: F.filter(F.array(s["name"], s["docstring"]), lambda x: x != "")))
    words = F.concat(own, "docstrings")
    return parsed.select(F.col("path").alias("file_path"), F.col("sha256").alias("file_hash"), F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.col("name")).alias("text"))


def embed(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], kept: DataFrame | None = None, dimension: int | None = None) -> DataFrame:
    """Embeddings of ``texts`` (file_path, file_hash, text) by ``encode``, a batch at a time on the
    executors; those in ``kept`` with the same hash are taken from there. Kept ones of another
    dimension count as missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_path": b["file_path"], "file_hash": b["file_hash"], "embedding": encode(b["text"].tolist())})

    if kept is None:
        return texts.mapInPandas(run, EMBEDDINGS)
    if dimension is not None:
        kept = kept.where(F.size("embedding") == dimension)
    keys = ["file_path", "file_hash"]
    missing = texts.join(kept.select(*keys), keys, "left_anti").mapInPandas(run, EMBEDDINGS)
    return kept.join(texts.select(*keys), keys, "left_semi").unionByName(missing)


def refresh(kept: DataFrame, new: DataFrame, current: DataFrame) -> DataFrame:
    """Kept embeddings with ``new`` in place of their own, less those of files not ``current``."""
    return cache.evicted(cache.upserted(kept, new, "file_path"), current.select(F.col("path").alias("file_path")), "file_path")
