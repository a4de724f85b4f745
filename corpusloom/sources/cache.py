"""What runs keep for later ones: parsed files, embeddings, the manifest of the last run."""

from __future__ import annotations

import json
import os
import re
import shutil
import tarfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, whether it was written to its end) of the versions of a kept table, oldest first."""
    fs, at = _hadoop(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((int(n[8:]), fs.exists(_hadoop(spark, f"{path}/{n}/_SUCCESS")[1])) for n in names if re.fullmatch(r"version=\d+", n))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A kept table, in the last version that was written to its end; none, or one of another schema, is
    empty."""
    done = [n for n, whole in _versions(spark, path) if whole]
    if done:
        found = spark.read.option("basePath", path).parquet(f"{path}/version={done[-1]}")
        own = lambda s: {(f.name, f.dataType) for f in s if f.name != "version"}
        if own(found.schema) == own(schema):
            return found.select(*schema.names)
    return spark.createDataFrame([], schema)


def replace_table(df: DataFrame, path: str) -> None:
    """Write the table's next version, and only then take the old ones away: whenever a run is killed, one
    version is there whole."""
    old = [n for n, _ in _versions(df.sparkSession, path)]
    df.write.parquet(f"{path}/version={max(old, default=0) + 1}")
    for n in old:
        drop(df.sparkSession, f"{path}/version={n}")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't in ``new``, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def evicted(table: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows whose key is current; all of them if nothing is current."""
    return table if current.isEmpty() else table.join(current.select(key).distinct(), key, "left_semi")


def split_by_cache(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached rows that hold, files to be done): a row holds if path and hash are the same, and the root
    where there is one."""
    keys = [k for k in ("root", "path", "sha256") if k != "root" or "root" in files.columns and "root" in cached.columns]
    return cached.join(files.select(*keys), keys, "left_semi"), files.join(cached.select(*keys), keys, "left_anti")


# -- manifest ---------------------------------------------------------------------------------------


def manifest(files: DataFrame, options: dict, version: str = "1") -> dict:
    """What a run was made of: its options and a hash over all (path, sha256), whose size doesn't grow
    with the tree."""
    one = files.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(path, sha256))").alias("x"), F.expr("sum(cast(xxhash64(sha256, path) as decimal(38, 0)))").alias("s")).first()
    return {"version": version, "generated_at": time.time(), "options": options, "files": [one["n"], str(one["x"]), str(one["s"])]}


def write_manifest(found: dict, path: str | Path) -> None:
    tmp = Path(f"{path}.{uuid.uuid4().hex}")
    tmp.parent.mkdir(parents=True, exist_ok=True)
    tmp.write_text(json.dumps(found), encoding="utf-8")
    os.replace(tmp, path)


def read_manifest(path: str | Path) -> dict | None:
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
        return found if isinstance(found, dict) else None
    except (OSError, ValueError):
        return None


def same_run(old: dict | None, new: dict) -> bool:
    return old is not None and all(old.get(k) == new[k] for k in ("version", "options", "files"))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (path, sha256) that are in one table only or have another hash: (path, change)."""
    a, b = old.select("path", F.col("sha256").alias("a")), new.select("path", F.col("sha256").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", change.alias("change"))


# -- archives ---------------------------------------------------------------------------------------


def export_archive(folder: str | Path, archive: str | Path) -> None:
    with tarfile.open(archive, "w:gz") as tar:
        tar.add(folder, arcname=".")


def import_archive(archive: str | Path, folder: str | Path) -> None:
    """Unpack; members that would leave the folder are refused."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with tarfile.open(archive, "r:gz") as tar:
        tar.extractall(folder, filter="data")


def _hadoop(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def fetch(spark: SparkSession, uri: str, folder: str | Path) -> None:
    """Copy a kept folder from wherever it is into a local one, which it replaces."""
    fs, at = _hadoop(spark, uri)
    shutil.rmtree(folder, ignore_errors=True)
    if fs.exists(at):
        Path(folder).parent.mkdir(parents=True, exist_ok=True)
        fs.copyToLocalFile(False, at, spark._jvm.org.apache.hadoop.fs.Path(f"file://{Path(folder).resolve()}"), True)


def put(spark: SparkSession, folder: str | Path, uri: str) -> None:
    """Copy a local folder to where runs keep it, which it replaces."""
    fs, to = _hadoop(spark, uri)
    fs.delete(to, True)
    if Path(folder).is_dir():
        fs.mkdirs(to.getParent())
        fs.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{Path(folder).resolve()}"), to)


def kept_bytes(spark: SparkSession, uri: str) -> int:
    fs, at = _hadoop(spark, uri)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def drop(spark: SparkSession, uri: str) -> None:
    fs, at = _hadoop(spark, uri)
    fs.delete(at, True)


def folder_bytes(folder: str | Path) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())
