"""Distributed connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b): component is the least node that
    can be reached.

    Alternating large-star and small-star: a round links every node's larger neighbours, then its
    smaller ones, to the least node it knows. Edges never grow in number, the rounds needed grow
    with the logarithm of the longest path, and the edges of a node with very many neighbours are
    met by partial minima and a join that can be split, never by a list of them. Each round's edges
    are written to the shared folder, so lineage stays short and lost executors cost one round.

    Defined cases: repeated edges and both directions are one edge; loops give a node of its own;
    edges with a null end are left out; an empty table gives no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null")
    alone = edges.select(F.col("a").alias("node")).where("a = b").distinct()
    e = common.stored(e.where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        # large-star: of each node, the larger neighbours are linked to the least of it and its neighbours
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: of each node, itself and the smaller neighbours are linked to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        e = common.stored(small, "edges")
        # settled once every node hangs on one other, and no node hangs on one that hangs itself
        up = e.select(F.col("a").alias("up"))
        if e.groupBy("a").count().where("count > 1").isEmpty() and e.join(up, e["b"] == up["up"], "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    known = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return known.unionAll(alone.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
