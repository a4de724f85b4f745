"""Keeps an index of documents current while their folder grows.

Each run reads the files that no earlier run has read, as a stream that ends with the last of them, and adds what
digests, searches and cross-references are made from: a row for each new version of a document, with its
hash, size, estimated tokens, first line and names. A document whose path and hash are known is not parsed
again, whichever file brings it.

``out/step=N/language=L`` holds what step N added, in Parquet. A step that a crash cut short is taken again
under its own number and replaces what it had written, so that each version is there once. ``current`` gives
the last version of each path. The checkpoint is the stream's own.

Defined cases: a null text is an empty one; a document without an id goes by its hash; of rows of one path in
one step, the one of the largest hash is the last; an empty or missing ``lang`` is kept and filed under ``und``;
an empty folder adds nothing.

    python -m jobs.document_index --documents PATH --out PATH --checkpoint PATH
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.sources import cache
from jobs import common

LOG = logging.getLogger("jobs.document_index")
CONFIG = Path(__file__).with_suffix(".toml")

ROWS = "doc_id long, path string, source string, lang string, sha256 string, change string, n_lines int, n_bytes long, tokens long, first_line string, names array<string>"
INDEX = ROWS + ", step long, language string"


def pattern(path: str) -> str:
    """``path`` as a pattern that only it fits: a stream takes a single file by a pattern alone."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1:].isalnum() else path


def kept(spark: SparkSession, out: str) -> DataFrame:
    """All versions that the index has; none where there is no index yet."""
    try:
        return spark.read.schema(INDEX).parquet(out)
    except Exception as e:  # noqa: BLE001  the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], INDEX)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last version of each path."""
    rows = kept(spark, out)
    last = rows.groupBy("path").agg(F.max(F.struct("step", "sha256")).alias("last")).select("path", "last.step", "last.sha256")
    return rows.join(last, ["path", "step", "sha256"])


def parsed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ROWS for the versions among ``docs`` that are not ``known`` (path, sha256)."""
    fresh = docs.dropDuplicates(["path", "sha256"])
    fresh = cache.split_by_cache(fresh, known)[1]
    met = fresh.join(known.select("path").distinct().withColumn("change", F.lit("changed")), "path", "left")
    text = F.col("text")
    return met.select(
        "doc_id", "path", "source", "lang", "sha256", F.coalesce("change", F.lit("added")).alias("change"), tx.line_count(text).alias("n_lines"), tx.byte_size(text).alias("n_bytes"),
        tx.estimated_tokens(text).alias("tokens"), tx.first_line(text).alias("first_line"), F.array_sort(tx.used_names(text)).alias("names"),
    )


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, files_at_once: int = 1000) -> DataFrame:
    """Take what is new under ``documents``; the index as it is then."""

    def step(rows: DataFrame, number: int) -> None:
        known = kept(rows.sparkSession, out).where(F.col("step") < number).select("path", "sha256")  # not what this step wrote before a crash
        new = parsed(common.documents(rows), known)
        language = F.when(F.coalesce("lang", F.lit("")) == "", "und").otherwise(F.col("lang"))
        path = f"{out}/step={number}"
        new.withColumn("language", language).write.mode("overwrite").partitionBy("language").parquet(path)
        LOG.info("step %d: %d versions written to %s", number, rows.sparkSession.read.schema(ROWS).parquet(path).count(), path)

    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(pattern(documents))
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%d rows read from %s in %d steps", sum(p["numInputRows"] for p in query.recentProgress), documents, sum(p["numInputRows"] > 0 for p in query.recentProgress))
    return current(spark, out)


if __name__ == "__main__":
    common.main("document_index", __doc__, CONFIG, run)
