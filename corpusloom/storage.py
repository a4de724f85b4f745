"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Only where one machine runs everything and names no folder in spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str | None:
    """The folder that driver and executors share; None where one machine runs everything and names none.
    A cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return None


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_root(spark) or LOCAL_CHECKPOINTS}/corpusloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, compression: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` there and read it back: lineage ends, no executor's loss undoes it, and columns are
    still pruned, which a checkpoint of an RDD prevents. ``options``: of the Parquet writer."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).option("compression", compression).parquet(path)
    release_at_exit(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, name: str, *counted: Column) -> tuple[DataFrame, list[int]]:
    """``stored``, and how many rows there are or, of each condition in ``counted``, for how many it
    holds, all from the one write."""
    seen = Observation()
    counts = [F.count_if(c) for c in counted] or [F.count(F.lit(1))]
    out = stored(df.observe(seen, *[c.alias(f"n{i}") for i, c in enumerate(counts)]), name)
    found = seen.get
    return out, [found.get(f"n{i}") or 0 for i in range(len(counts))]


_RELEASED: set[str] = set()


def _folder(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def release_at_exit(spark: SparkSession) -> None:
    """Have this application's stored tables deleted when its driver ends."""
    if spark.sparkContext.applicationId not in _RELEASED:
        fs, path = _folder(spark)
        fs.deleteOnExit(path)
        _RELEASED.add(spark.sparkContext.applicationId)


def release(spark: SparkSession) -> None:
    """Delete this application's stored tables at once, when no result that reads them is needed."""
    fs, path = _folder(spark)
    fs.delete(path, True)
    _RELEASED.discard(spark.sparkContext.applicationId)
