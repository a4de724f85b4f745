"""An inverted file over embeddings: an exact search that reads some of the cells.

Cells are those of k-means, fitted on ``SAMPLE`` vectors at most; every vector is in the cell of its nearest
center, and the table is partitioned by cell, so that a cell is a folder. Of each cell its center and its
radius, the largest angle between the center and a member, are kept. By the triangle inequality of angles
no member of a cell is nearer to a query than the center's angle less the radius, nor farther than their
sum: cells are read in the order of these bounds, and reading ends when none that is left can change the
result.

Defined cases: vectors without length have a cell of their own, at a right angle to everything; null vectors
aren't in the index; vectors of another dimension than the first's are refused; an empty table has no cells
and finds nothing; equal vectors are told apart by their key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir
from . import semantic

#: Vectors that centers are fitted on, and cells, at most.
SAMPLE, CELLS = 20_000, 1024
#: Cells that a search reads first; each further look takes twice as many.
LOOK = 4
#: Of angles and of distances, beyond what arithmetic and rounding to six decimals can move.
_SLACK = 1e-5


def centers(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` centers of vectors of length 1 by Lloyd's rounds from evenly spread ones."""
    out = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (vectors @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1)
        out = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], out)
    return out


def matrix(rows: list[list[float]]) -> np.ndarray:
    found = sorted({len(x) for x in rows})
    if len(found) > 1:
        raise ValueError(f"vectors of {found[0]} and of {found[-1]} numbers")
    return np.array(rows, float).reshape(len(rows), -1) if rows else np.zeros((0, 0))


@dataclass
class Index:
    """``path`` has the vectors by cell; the rest is about cells: their numbers, centers and radii. ``probed``
    are the cells that the last search read."""

    spark: SparkSession
    path: str
    schema: str
    cells: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    probed: tuple[int, ...] = ()

    def _bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest angle to the query that members can have."""
        angle = np.arccos(np.clip(self.centers @ query, -1, 1))
        low, high = np.maximum(angle - self.radii, 0), np.minimum(angle + self.radii, np.pi)
        return np.where(self.cells < 0, np.pi / 2, low), np.where(self.cells < 0, np.pi / 2, high)

    def _read(self, some: list[int], query: list[float]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path).drop("_angle").where(F.col("cell").isin([int(c) for c in some]))
        return rows.withColumn("distance", semantic.cosine_distance(F.col("embedding"), F.lit(query)))

    def _farthest(self, query: list[float], high: np.ndarray, read: set[int]) -> float:
        order, most, step = np.argsort(-high), 0.0, LOOK
        at = 0
        while at < len(order) and 1 - math.cos(high[order[at]]) + _SLACK >= most:
            some = order[at : at + step]
            found = self._read(self.cells[some].tolist(), query).agg(F.max("distance").alias("d")).first()["d"]
            read.update(self.cells[some].tolist())
            most, at, step = max(most, found or 0.0), at + step, 2 * step
        return most

    def search(self, query: list[float], k: int, key: str) -> DataFrame:
        """As ``semantic.top(semantic.relevance(...), k, key)``, over the cells that matter."""
        query = [float(x) for x in query]
        length = math.sqrt(sum(x * x for x in query))
        if not length or not len(self.cells):
            return self._read([], query).withColumn("relevance", F.lit(0.0)).drop("cell")
        low, high = self._bounds(np.array(query) / length)
        read: set[int] = set()
        most = self._farthest(query, high, read) or 1.0
        order, at, step, kept = np.argsort(low, kind="stable"), 0, LOOK, math.inf
        best: list[float] = []
        while at < len(order) and 1 - math.cos(low[order[at]]) <= kept:
            some = self.cells[order[at : at + step]].tolist()
            best = sorted(best + [r["distance"] for r in self._read(some, query).select("distance").orderBy("distance").limit(k).collect()])[:k]
            if len(best) == k:
                kept = best[-1] + 2e-6 * most + _SLACK  # what rounds to the same relevance may come first by its key
            at, step = at + step, 2 * step
        near = self.cells[order[:at]].tolist()
        self.probed = tuple(sorted(read.union(near)))
        rows = self._read(near, query).where(F.col("distance") <= F.lit(kept)).drop("cell")
        return semantic.top(rows.withColumn("relevance", F.round(F.greatest(F.lit(1.0) - F.col("distance") / F.lit(most), F.lit(0.0)), 6)), k, key)


def build(embeddings: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of ``embeddings`` (..., embedding), stored by cell."""
    spark, path = embeddings.sparkSession, f"{shared_dir(embeddings.sparkSession)}/vectors-{uuid.uuid4().hex}"
    rows = embeddings.where("embedding is not null")
    some = rows.orderBy(F.xxhash64("embedding")).select(F.col("embedding").cast("array<double>").alias("e")).limit(sample).toArrow().column("e")
    unit = matrix([x for x in some.to_pylist() if any(x)])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True) if len(unit) else unit
    fitted = centers(unit, min(len(unit), cells or max(1, min(CELLS, round(math.sqrt(rows.count())))))) if len(unit) else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("_vector").to_pylist())
            if b.num_rows and fitted.size and v.shape[1] != fitted.shape[1]:
                raise ValueError(f"vectors of {v.shape[1]} and of {fitted.shape[1]} numbers")
            size = np.linalg.norm(v, axis=1)
            cell, angle = np.full(len(v), -1), np.zeros(len(v))
            if fitted.size and len(v):
                cos = v @ fitted.T / np.where(size > 0, size, 1)[:, None]
                cell = np.where(size > 0, cos.argmax(axis=1), -1)
                angle = np.where(size > 0, np.arccos(np.clip(cos.max(axis=1), -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], [*names, "cell", "_angle"])

    names = [f.name for f in rows.schema]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "cell int", "_angle double"])
    dealt = rows.withColumn("_vector", F.col("embedding").cast("array<double>")).mapInArrow(assign, schema)
    dealt.repartition("cell", F.xxhash64("embedding") % 4).write.partitionBy("cell").parquet(path)  # a cell may hold a third of all
    known = {r["cell"]: r["r"] for r in spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.max("_angle").alias("r")).collect()} if fitted.size else {}  # a row for each cell
    numbers = np.array(sorted(known), int)
    return Index(spark, path, schema, numbers, np.array([fitted[c] if c >= 0 else np.zeros(fitted.shape[1]) for c in numbers]) if len(numbers) else fitted, np.array([known[c] + _SLACK for c in numbers]))
