"""Filling a token budget in order of tier, score and path.

Tiers 1 and 2 are taken while they fit; the first that doesn't is cut to what is left. Tier 3 then
takes each that fits and passes over the others. No table is sorted whole, and no score's files are
gathered, however many share it: sums by (tier, score), of which there are three million at most,
show the one score in which room runs out, and only of that score are files put in order, a bounded
number at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files of one score that are put in order at once.
STEP = 100_000


def fill_whole(rows: DataFrame, budget: int) -> DataFrame:
    """``rows`` (path, score, tier, tokens) of tiers 1 and 2 that the budget reaches, with ``charged``;
    less than ``tokens`` if cut."""
    own = rows.where("tier < 3").withColumn("charged", F.col("tokens").cast("long"))
    if budget <= 0:
        return own.limit(0)
    sums = own.groupBy("tier", "score").agg(F.sum("tokens").alias("_t"))
    order = Window.orderBy("tier", F.desc("score"))  # a row for each distinct score
    over = sums.withColumn("_upto", F.sum("_t").over(order)).where(F.col("_upto") >= budget).orderBy("tier", F.desc("score")).limit(1).first()
    if over is None:
        return own
    tier, score, left = over["tier"], over["score"], budget - (over["_upto"] - over["_t"])
    before = (F.col("tier") < tier) | ((F.col("tier") == tier) & (F.col("score") > score))
    same = (F.col("tier") == tier) & (F.col("score") == score)
    # the file in which the budget ends: that of a prefix of the paths, so many at a time
    at, last = "", left
    while left > 0:
        some = own.where(same & (F.col("path") > at) & (F.col("tokens") > 0)).select("path", "tokens").orderBy("path").limit(STEP).collect()
        for r in some:
            at, last = r["path"], left
            left -= r["tokens"]
            if left <= 0:
                break
        if not some:
            break
    cut = F.when(same & (F.col("path") == at), F.least("tokens", F.lit(last))).otherwise(F.col("tokens"))
    return own.where(before | (same & (F.col("path") <= at))).withColumn("charged", cut.cast("long"))


def fill_skipping(rows: DataFrame, left: int) -> DataFrame:
    """``rows`` of tier 3 that greedy filling of ``left`` tokens takes, with ``charged``.

    Files larger than the room are passed over, now and later, as room only shrinks. Of the others all
    scores from the best on are taken whole as long as their sums fit. The files of the first score
    that doesn't are walked in the order of their paths, and so on with the room that is left.
    """
    own = rows.where("tier = 3").withColumn("charged", F.col("tokens").cast("long"))
    whole: list[Column] = []
    single: list[str] = []
    score, path, room = None, None, left  # what comes after (score, path) is still open
    while room > 0:
        ahead = F.lit(True) if score is None else F.col("score") < score
        if path is not None:
            ahead = ahead | ((F.col("score") == score) & (F.col("path") > path))
        fit = own.where(ahead & (F.col("tokens") <= room))
        upto = F.sum("_t").over(Window.orderBy(F.desc("score")))  # a row for each distinct score
        over = fit.groupBy("score").agg(F.sum("tokens").alias("_t")).withColumn("_upto", upto).where(F.col("_upto") > room).orderBy(F.desc("score")).limit(1).first()
        if over is None:
            whole.append(ahead & (F.col("tokens") <= room))
            break
        whole.append(ahead & (F.col("tokens") <= room) & (F.col("score") > over["score"]))
        room -= over["_upto"] - over["_t"]
        some = fit.where((F.col("score") == over["score"]) & (F.col("tokens") <= room)).select("path", "tokens").orderBy("path").limit(STEP).collect()
        score, path = over["score"], some[-1]["path"] if len(some) == STEP else None
        for r in some:
            if r["tokens"] <= room and room > 0:
                single.append(r["path"])
                room -= r["tokens"]
    if not whole:
        return own.limit(0)
    taken = own.where(reduce(or_, whole))
    if not single:
        return taken
    named = rows.sparkSession.createDataFrame([(p,) for p in single], "path string")  # no more than the budget has tokens
    return taken.unionByName(own.join(F.broadcast(named), "path", "left_semi"))


def fill(rows: DataFrame, budget: int) -> DataFrame:
    """All rows that get into the budget, with ``charged``."""
    whole = fill_whole(rows, budget)
    used = whole.agg(F.coalesce(F.sum("charged"), F.lit(0)).alias("n")).first()["n"]
    return whole.unionByName(fill_skipping(rows, budget - used))
