"""Change events of a source tree, gathered into quiet batches."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..functions import paths
from ..storage import stored

EVENTS = "src_path string, is_directory boolean, ts timestamp"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """Events that a watcher drops into a folder as JSON lines."""
    return spark.readStream.schema(schema).json(folder)


def batches(events: DataFrame, delay: float = config.DEBOUNCE_SECONDS, late: str = "10 seconds", key: str | None = None) -> DataFrame:
    """Rows (start, end, events, paths): the set of paths that changed until it was quiet for ``delay``
    seconds. Works on a stream, with a watermark, and on a table alike; a stream is to be started within
    ``state_store``. ``key`` keeps trees apart."""
    rows = events.where(~F.coalesce("is_directory", F.lit(False)) & (F.coalesce("src_path", F.lit("")) != ""))
    if not events.isStreaming:
        return _of_table(rows, delay, key)
    own = rows.schema[key].dataType if key else None
    # null is a tree of its own; every other one begins with a sign
    tree = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")) if key else F.lit("")
    quiet = int(delay * 1_000_000)
    parts = rows.where("ts is not null").select(tree.alias("_tree"), "src_path", F.unix_micros("ts").alias("at")).mapInPandas(_parts(quiet), PART)
    parts = parts.withColumns({"lo": F.timestamp_micros("lo"), "_open": F.make_interval(secs=((F.col("hi") - F.col("lo") + quiet).cast("decimal(24,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))})
    found = parts.withWatermark("lo", late).groupBy("_tree", F.session_window("lo", F.col("_open")).alias("_at")).agg(F.sum("events").alias("events"), F.collect_list("paths").alias("paths"))
    keyed = [F.when(F.col("_tree") != "", F.substring("_tree", 2, 1 << 30)).cast(own).alias(key)] if key else []
    return found.select(*keyed, F.col("_at.start").alias("start"), F.col("_at.end").alias("end"), "events", F.array_sort(F.array_distinct(F.flatten("paths"))).alias("paths"))


PART = "_tree string, lo long, hi long, events long, paths array<string>"


def _parts(quiet: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of a partition of events (_tree, src_path, at) the batches that these alone make, so that a tree's task
    joins batches, not events, and one more with the last event alone: the watermark goes by where batches begin."""

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby(["_tree", "step", "src_path"], sort=False, as_index=False).agg(lo=("lo", "min"), hi=("hi", "max"), n=("n", "sum"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            if len(b):  # events of one path and step of time are of one batch
                held.append(added(b.assign(step=b["at"] // quiet, lo=b["at"], hi=b["at"], n=1)))
                size += len(held[-1])
            if len(held) > 1 and size > 2 * len(held[0]):
                held = [added(pd.concat(held))]
                size = len(held[0])
        if not held:
            return
        rows = added(pd.concat(held)).sort_values(["_tree", "lo"], ignore_index=True)
        until = rows.groupby("_tree")["hi"].cummax().shift()
        fresh = (rows["_tree"] != rows["_tree"].shift()) | (rows["lo"] - until > quiet)
        out = rows.groupby(["_tree", fresh.cumsum().rename("batch")]).agg(lo=("lo", "min"), hi=("hi", "max"), events=("n", "sum"), paths=("src_path", lambda p: list(set(p)))).reset_index()
        last = out.loc[[out["hi"].idxmax()]]
        yield pd.concat([out, last.assign(lo=last["hi"], events=0, paths=[[]])])[["_tree", "lo", "hi", "events", "paths"]]

    return run


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB; the session's own setting comes back."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, was)


def write_batches(events: DataFrame, out: str, checkpoint: str, delay: float = config.DEBOUNCE_SECONDS, late: str = "10 seconds", key: str | None = None) -> StreamingQuery:
    """Closed batches of what is there now, as Parquet below ``out``, each once over any number of runs."""
    with state_store(events.sparkSession):
        writer = batches(events, delay, late, key).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return writer.trigger(availableNow=True).start()


def _of_table(rows: DataFrame, delay: float, key: str | None) -> DataFrame:
    """``batches`` of a table, in which one tree may have all events: they are first added up by path and
    step of ``delay``, within which they are of one batch, and batches are told apart on the steps."""
    quiet = int(delay * 1_000_000)
    tree = F.col(key) if key else F.lit(0)
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    steps = rows.groupBy(tree.alias("_tree"), F.floor(ts / F.lit(quiet)).alias("_step"), "src_path").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count("*").alias("_n"))
    marks = steps.groupBy("_tree", "_step").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))  # as many as time has steps
    order = Window.partitionBy("_tree").orderBy("_step")
    fresh = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) > quiet, F.lit(True)).cast("int")
    marks = marks.withColumn("_fresh", fresh).withColumn("_batch", F.sum("_fresh").over(order)).select(F.col("_tree").alias("_t"), F.col("_step").alias("_s"), "_batch")
    met = steps.join(marks, F.col("_tree").eqNullSafe(F.col("_t")) & (F.col("_step") == F.col("_s")))
    found = met.groupBy("_tree", "_batch").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.sum("_n").alias("events"), F.collect_set("src_path").alias("paths"))
    own = [F.col("_tree").alias(key)] if key else []
    return found.select(*own, F.timestamp_micros("lo").alias("start"), F.timestamp_micros(F.col("hi") + quiet).alias("end"), "events", F.array_sort("paths").alias("paths"))


def relevant(found: DataFrame) -> DataFrame:
    """Batches with the watched paths alone; without any they are dropped."""
    return found.withColumn("paths", F.filter("paths", paths.is_watched)).where(F.size("paths") > 0)


def watch(events: DataFrame, handle: Callable[[list[str]], None], checkpoint: str, delay: float = config.DEBOUNCE_SECONDS, once: bool = False) -> StreamingQuery:
    """Call ``handle`` with the sorted paths of each quiet batch. An error in it ends that batch alone."""

    def each(df: DataFrame, _: int) -> None:
        closed = stored(relevant(df), "closed_batches")  # sorting reads them twice
        for r in closed.orderBy("start").toLocalIterator():
            try:
                handle(list(r["paths"]))
            except Exception as e:  # noqa: BLE001  the next change may mend it
                print(f"batch failed: {e}")

    with state_store(events.sparkSession):
        writer = batches(events, delay).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def first_seen(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each (path, hash) once within a time: rows whose content was met before are dropped."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["src_path", "sha256"])
