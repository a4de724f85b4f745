"""Writes a ranked digest of documents that fits a token budget.

Documents are scored by how often and how lately the change log names them, and by how many others use
names that they have first; the best become the core and are shown whole, the next with their beginning, the
others with their first line. What is shown is taken in the order of tier, score and path until the budget is
used, the last of the first two tiers cut to what is left.

``out/task=T/source=S`` holds the digest for a task, in Parquet, by the documents' source. A run replaces its
own task's digest and leaves those of others; the same inputs give the same rows.

Defined cases: a null text is an empty one; rows of one path (the same source, lang and id) are one document,
the one of the largest hash; documents that the log doesn't name have no changes and are a year old; a log
without rows changes nothing; a missing source is filed under ``none``; no documents give an empty digest.

    python -m jobs.context_digest --documents PATH --changes PATH --out PATH
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import budget as budgets
from corpusloom.operators import rank, resolve
from corpusloom.sources import repo_files
from corpusloom.storage import stored, stored_counted
from jobs import common

LOG = logging.getLogger("jobs.context_digest")
CONFIG = Path(__file__).with_suffix(".toml")

#: Letters that a document of the second tier and one of the third are shown with.
BEGINNING, LINE = 400, 80
DIGEST = "path string, tier int, score double, tokens long, charged long, content string, source string"


def latest(docs: DataFrame) -> DataFrame:
    """One row of each path, that of the largest hash: only rows of paths that come again are compared."""
    again, (n,) = stored_counted(docs.groupBy("path").count().where("count > 1").select(F.col("path").alias("again")), "paths_again")
    if not n:
        return docs
    again = F.broadcast(again) if n <= resolve.BROADCAST else again
    same = docs.join(again, F.col("path") == F.col("again"), "left_semi").groupBy("path").agg(F.max(F.struct("sha256", "doc_id", "source", "text")).alias("x"))
    return docs.join(again, F.col("path") == F.col("again"), "left_anti").select("path", "sha256", "doc_id", "source", "text").unionByName(same.select("path", "x.*"))


def signals(files: DataFrame, log: DataFrame, task: str) -> DataFrame:
    """Rows (path, freq, recency, fan_in, symbols, proximity, depth): what documents are ranked by."""
    names = files.select("path", F.explode("names").alias("name"))
    met = resolve.cross_references(names, names, distinct=True).select("defined_in", "used_in").distinct()
    fan_in = met.groupBy(F.col("defined_in").alias("path")).agg(F.count("*").alias("fan_in"))
    own = files.select("doc_id", "path", F.when(F.size("names") > 0, F.size("names").cast("long")).alias("symbols"))
    named = log.join(own, "doc_id").select("path", "ts")
    stats = repo_files.change_stats(named, own.select("path", F.lit(None).cast("double").alias("mtime")))
    as_of = log.agg(F.max("ts").alias("t")).first()["t"] or 0.0
    rows = own.select("path", "symbols").join(stats, "path", "left").join(fan_in, "path", "left")
    days = rank.days_since(F.col("last_modified_ts"), as_of)
    none = F.lit(0.0)  # documents have no entry points
    return rows.select("path", F.col("commit_count").alias("freq"), rank.recency(days, task).alias("recency"), "fan_in", "symbols", none.alias("proximity"), none.alias("depth"), F.lit(False).alias("cyclic"))


def digest(docs: DataFrame, files: DataFrame, log: DataFrame, task: str, tokens: int) -> DataFrame:
    """Rows of DIGEST: what gets into ``tokens``. ``docs`` (path, sha256, text), ``files`` (path, sha256, doc_id,
    source, names, and the letters that each tier shows) and ``log`` (doc_id, ts) are tables. Texts are read again of
    the documents that are taken alone, of which there are no more than tokens."""
    ranked = rank.tiers(stored(rank.score(signals(files, log, task), task).select("path", "score"), "scores"))
    letters = F.when(F.col("tier") == 1, F.col("whole")).when(F.col("tier") == 2, F.col("beginning")).otherwise(F.col("line"))
    shown = files.select("path", "sha256", "source", "whole", "beginning", "line").join(ranked, "path")
    rows = stored(shown.select("path", "sha256", "source", "tier", "score", F.ceil(letters / 4).cast("long").alias("tokens")), "shown")
    taken = stored(budgets.fill(rows, tokens), "taken")
    with_text = F.broadcast(taken.where("tokens > 0").select("path", "sha256", "tier"))  # no more than the budget has tokens
    text = F.col("text")
    content = F.when(F.col("tier") == 1, text).when(F.col("tier") == 2, F.left(text, F.lit(BEGINNING))).otherwise(F.left(tx.first_line(text), F.lit(LINE)))
    texts = docs.join(with_text, ["path", "sha256"]).select("path", content.alias("content")).dropDuplicates(["path"])
    out = taken.join(texts, "path", "left").withColumn("content", F.coalesce("content", F.lit("")))
    cut = F.when(F.col("charged") < F.col("tokens"), tx.truncated(F.col("content"), F.col("charged"))).otherwise(F.col("content"))
    return out.select("path", "tier", "score", "tokens", "charged", cut.alias("content"), "source")


def run(spark: SparkSession, documents: str, changes: str, out: str, changed: str = "user_id", task: str = "default", budget: int = 120_000) -> DataFrame:
    """Write the digest for ``task``; all of ``out``'s for it as read back."""
    read = Observation()
    docs = common.documents(spark.read.parquet(documents))
    text = F.col("text")
    letters = [F.length(text).alias("whole"), F.length(F.left(text, F.lit(BEGINNING))).alias("beginning"), F.length(F.left(tx.first_line(text), F.lit(LINE))).alias("line")]
    files = stored(latest(docs).select("path", "sha256", "doc_id", "source", tx.used_names(text).alias("names"), *letters), "files")
    docs.observe(read, F.count("*").alias("n")).select(F.lit(1)).write.format("noop").mode("overwrite").save()
    LOG.info("%d documents read from %s", read.get["n"] or 0, documents)
    log = spark.read.parquet(changes).select(F.col(changed).cast("long").alias("doc_id"), F.col("ts").cast("timestamp").cast("double").alias("ts")).where("doc_id is not null and ts is not null")
    wrote = Observation()
    rows = digest(docs, files, log, task, budget).withColumn("source", F.when(F.coalesce("source", F.lit("")) == "", "none").otherwise(F.col("source")))
    path = f"{out}/task={task}"
    rows.observe(wrote, F.count("*").alias("n"), F.sum("charged").alias("charged")).write.mode("overwrite").partitionBy("source").parquet(path)
    LOG.info("%d documents with %d of %d tokens written to %s", wrote.get["n"] or 0, wrote.get["charged"] or 0, budget, path)
    return spark.read.schema(DIGEST).parquet(path)


if __name__ == "__main__":
    common.main("context_digest", __doc__, CONFIG, run)
