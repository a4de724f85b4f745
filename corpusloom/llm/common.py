"""What several operators share: tables, batches of bounded size, memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import release_at_exit, shared_dir, stored, stored_counted

__all__ = ["ascii_lower", "free_name", "frugal", "mapped", "sized", "slices", "stored", "stored_bucketed", "stored_counted", "stored_large", "table"]

#: Bytes of rows that a Python worker is handed at once; one larger row is handed alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The GNU C library's M_ARENA_MAX, M_MMAP_THRESHOLD and M_TRIM_THRESHOLD, and what they are set to.
_MALLOPT = ((-8, 1), (-3, 8 << 20), (-1, 16 << 20))
#: Parquet's groups of rows for tables whose cells have megabytes: writers and readers hold one group.
LARGE_CELLS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(values: list, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` (texts or bytes, never None) of about ``limit`` units at most; one
    longer value is a range of its own."""
    start = held = 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            yield start, i
            start, held = i, 0
        held += len(v)
    if start < len(values):
        yield start, len(values)


def ascii_lower(c: Column) -> Column:
    """A-Z only, in every locale and for every other letter."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """As ``sized``, for an Arrow array of strings or binaries, in bytes."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(end):
        stop = max(start + 1, int(np.searchsorted(end, limit + (end[start - 1] if start else 0), "right")))
        yield start, stop
        start = stop


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a Python worker that keeps no more memory than it uses: large freed blocks go back to
    the system at once, and all that is left after the partition. Workers stay for later tasks, also of
    stages that need their memory elsewhere."""

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such calls
            for option, value in _MALLOPT:
                libc.mallopt(option, value)
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                libc.malloc_trim(0)

    return tidy


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with ``frugal`` workers and batches bounded in bytes, as rows can be of any
    length; the bound is the session's from here on, unless that has a lower one."""
    conf = df.sparkSession.conf
    if int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(_BATCH))) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(frugal(run), schema)


def stored_large(df: DataFrame, name: str, compression: str = "lz4") -> DataFrame:
    """``stored`` for tables whose cells have megabytes."""
    return stored(df, name, compression, LARGE_CELLS)


def stored_bucketed(df: DataFrame, name: str, buckets: int, keys: tuple[str, ...]) -> DataFrame:
    """``stored``, in buckets by ``keys``: a join on these shuffles its other side alone. ``name`` has to
    be one that no other table has."""
    df.write.option("compression", "zstd").option("path", f"{shared_dir(df.sparkSession)}/{name}").bucketBy(buckets, *keys).saveAsTable(name)
    release_at_exit(df.sparkSession)
    return df.sparkSession.table(name)
