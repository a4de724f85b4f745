"""Scores of ranked entities from their signals, and tiers by percentile.

Signals come as one row per entity. Minima and maxima of all signals are one row from one aggregation,
broadcast back; no window runs over the whole table. Thresholds of tiers come from a histogram of the
scores, which have six decimals and so a million values at most.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def days_since(last_ts: Column, as_of: float) -> Column:
    """Days from a time in seconds to ``as_of``, none below zero; a year where nothing is known."""
    return F.coalesce(F.greatest((F.lit(float(as_of)) - last_ts) / F.lit(86400.0), F.lit(0.0)), F.lit(config.AGE_DAYS))


def recency(days: Column, task: str = "default") -> Column:
    """Nearness in time; for refactoring the age itself."""
    return days if task == "refactor" else F.lit(1.0) / (F.lit(1.0) + days)


def nearness(dist: Column) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + dist.cast("double")), F.lit(0.0))


def normalized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` brought to 0..1 over all rows; a constant one is 0."""
    ends = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    met = rows.crossJoin(F.broadcast(ends))  # one row
    scaled = {c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0) for c in columns}
    return met.withColumns(scaled).select(*rows.columns)


def score(signals: DataFrame, task: str = "default", semantic: bool = False) -> DataFrame:
    """``signals`` (path, freq, fan_in, recency, proximity, symbols, depth, cyclic, and with
    ``semantic`` relevance) with ``score``: weighted normal signals, plus relevance as it is, less a
    penalty on a cycle, held in 0..1, six decimals. Weighted signals come out normal."""
    own = config.weights(task, semantic)
    used = [s for s in config.SIGNALS if own[s]]
    rows = normalized(signals.withColumns({s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in used}), used)
    total = reduce(add, [F.lit(own[s]) * F.col(s) for s in used])
    if semantic:
        total = total + F.lit(config.SEMANTIC_WEIGHT) * F.coalesce("relevance", F.lit(0.0))
    total = total - F.when(F.coalesce("cyclic", F.lit(False)), F.lit(config.CYCLE_PENALTY)).otherwise(0.0)
    return rows.withColumn("score", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 6))


def thresholds(scores: DataFrame) -> DataFrame:
    """One row (t1, t2): the scores at 15 and 45 in a hundred from above, at least the first and the
    second; null where there are no scores."""
    histogram = scores.groupBy("score").agg(F.count("*").alias("n"))
    upto = histogram.select("score", F.sum("n").over(Window.orderBy(F.desc("score"))).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("n"))  # a row for each distinct score
    first = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.15)))
    second = F.least(F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(0.45))), F.col("n"))
    return upto.agg(F.max(F.when(F.col("upto") >= first, F.col("score"))).alias("t1"), F.max(F.when(F.col("upto") >= second, F.col("score"))).alias("t2"))


def tiers(scores: DataFrame, overrides: Column | None = None) -> DataFrame:
    """``scores`` with ``tier``: 1 from t1 up, 2 from t2 up, else 3; rows of ``overrides`` are 3, which
    doesn't move the thresholds. Ties are promoted."""
    tier = F.when(F.col("score") >= F.col("t1"), 1).when(F.col("score") >= F.col("t2"), 2).otherwise(3)
    if overrides is not None:
        tier = F.when(F.coalesce(overrides, F.lit(False)), 3).otherwise(tier)
    return scores.crossJoin(F.broadcast(thresholds(scores))).withColumn("tier", tier.cast("int")).drop("t1", "t2")  # one row
