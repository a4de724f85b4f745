"""A Merkle manifest of a table: a hash tree over its rows, an inclusion proof for each, and their check.

H is the lowercase hex sha256 of its inputs, concatenated; digests go in as hex text. A row's leaf is H of
its fields, each ``-`` where null, else its count of UTF-8 bytes, ``:`` and its value. The leaves of a group
lie in order; each ``fanout`` of a level that follow each other, the last run with as many as there are,
even one, become their H, until one node, the subroot, is left. Nothing is padded. The subroots, in order
of their groups, are the leaves of one more tree, whose top is the root.

How a tree is built over leaves in any number of tasks:

* Leaves are dealt by sampled ranges of (group, order) and numbered there, and each run, the leaves of a group
  in one task, learns its first leaf's index from the counts of the runs before.
* A run goes through a mountain range: a stack for each level holds nodes whose parent is not complete, and
  a node that completes its parent's children is carried up as their H. What is left at the end are the
  peaks; so are children at the run's unaligned left edge, whose parent began in another task. As the count
  of leaves is known, a short last run is complete like any other.
* Peaks, a handful for each level of a run, are merged by ``MERGED`` runs at a time, again and again, until
  a group has one run: adjacent edges complete the parents that lie across tasks.
* For the proofs, each run gets the nodes around it, its edges' siblings on every level, and walks up
  from each leaf through its own nodes and these.

A task holds a run's hashes (``RUN`` leaves or so); texts are hashed where they lie and never shuffled. Nothing
about rows reaches the driver but their count and the largest number of runs.

Defined cases: a null group is one group, before the others, which are in the order of their bytes; null
doc_ids come first; rows of one doc_id are in the order of their leaves, and equal rows are leaves each; an
empty table has no tree and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Leaves that a run has about, at most.
RUN = 100_000
#: Runs whose peaks are merged at once.
MERGED = 256

NODE = "g string, run long, level int, j long, hash string, total long, edge boolean, fresh boolean"
AROUND = ("part", "g", "level", "j", "hash", "index", "total")
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """H of the fields of a row."""
    shown = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]), 256)


def sizes(total: int, fanout: int) -> list[int]:
    """Nodes of each level, from the leaves to the top."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Mountains:
    """The nodes over leaves ``first`` on, pushed in order, of a tree of ``total`` leaves. ``node`` is called
    with each (level, index, hash) that becomes known, ``peak`` with those whose parent doesn't."""

    def __init__(self, first: int, total: int, fanout: int, node: Callable[[int, int, str], object], peak: Callable[[int, int, str], object]):
        self._sizes, self._fanout, self._node, self._peak = sizes(total, fanout), fanout, node, peak
        self._stacks: list[list[str]] = [[] for _ in self._sizes]
        self._next = [first] + [-1] * len(self._sizes)

    def push(self, hash_: str) -> None:
        level = 0
        while True:
            j, stack = self._next[level], self._stacks[level]
            self._node(level, j, hash_)
            stack.append(hash_)
            self._next[level] = j + 1
            if self._sizes[level] == 1 or j + 1 < self._sizes[level] and (j + 1) % self._fanout:
                return
            if len(stack) < j % self._fanout + 1:  # the run began in another task
                self._drop(level)
                return
            hash_ = digest(stack)
            stack.clear()
            level += 1
            if self._next[level] < 0:
                self._next[level] = j // self._fanout

    def _drop(self, level: int) -> None:
        stack = self._stacks[level]
        for i, x in enumerate(stack):
            self._peak(level, self._next[level] - len(stack) + i, x)
        stack.clear()

    def finish(self) -> None:
        for level in range(len(self._stacks)):
            self._drop(level)


def merge(known: dict[tuple[int, int], str], total: int, fanout: int, node: Callable[[int, int, str], object]) -> None:
    """Complete all parents whose children are in ``known``, by (level, index), and take these out."""
    for level, size in enumerate(sizes(total, fanout)[:-1]):
        for parent in sorted({j // fanout for at, j in known if at == level}):
            children = range(parent * fanout, min(size, (parent + 1) * fanout))
            if all((level, j) in known for j in children):
                top = digest([known.pop((level, j)) for j in children])
                node(level + 1, parent, top)
                known[level + 1, parent] = top


def indexed(leaves: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(stored leaves with ``part`` and ``pos``, their place in the run; runs: part, g, the ``first`` leaf's
    index, ``n``, ``total`` of the group and ``run``, the run's number there)."""
    spark = leaves.sparkSession
    leaves, (n,) = common.stored_counted(leaves, "leaves")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000), -(-n // RUN))
    names = [f.name for f in leaves.schema]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, group, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(names.index("g")).dictionary_encode()
            code = g.indices.to_numpy()
            start = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
            pos = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
            if g.dictionary[code[0]].as_py() == group:
                pos[: start[1] if len(start) > 1 else len(pos)] += at
            group, at = g.dictionary[code[-1]].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(pos), pa.int32()), pa.array(pos, pa.int64())], [*names, "part", "pos"])

    keys = [F.col("g"), *order, F.monotonically_increasing_id()]
    ranges = leaves.withColumn("_tie", keys.pop()).repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    dealt = common.stored(common.mapped(ranges, number, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema), "part int", "pos long"])), "numbered_leaves")
    by = Window.partitionBy("g").orderBy("part")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")
    runs = dealt.groupBy("part", "g").agg(F.count("*").alias("n")).select("part", "g", "n", before, F.sum("n").over(Window.partitionBy("g")).alias("total"), (F.row_number().over(by) - 1).cast("long").alias("run"))
    return dealt, common.stored(runs, "runs")


def batch(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def in_order(t: pa.Table) -> pa.Table:
    return t.take(np.argsort(t["pos"].to_numpy(), kind="stable"))


def nodes(leaves: DataFrame, runs: DataFrame, fanout: int, records: bool = False) -> DataFrame:
    """Rows of NODE: what the runs' peaks are and become. ``edge``: a peak of the last merge; ``fresh``: a peak of
    a run, or a node that a merge made. With ``records`` also all nodes within runs, neither."""

    def climb(t: pa.Table) -> pa.Table:
        t = in_order(t)
        first, total, g, run = (t[c][0].as_py() for c in ("first", "total", "g", "run"))
        own: dict[tuple[int, int], str] = {}
        peaks: list[tuple] = []
        m = Mountains(first, total, fanout, lambda level, j, x: own.__setitem__((level, j), x) if records else None, lambda level, j, x: peaks.append((level, j, x)))
        for x in t["leaf"].to_pylist():
            m.push(x)
        m.finish()
        for level, j, _ in peaks:
            own.pop((level, j), None)
        rows = [(g, run, level, j, x, total, True, True) for level, j, x in peaks]
        return batch(rows + [(g, run, level, j, x, total, False, False) for (level, j), x in own.items()], NODE)

    def join(t: pa.Table) -> pa.Table:
        g, run, total = t["g"][0].as_py(), t["run"][0].as_py() // MERGED, t["total"][0].as_py()
        known = dict(zip(zip(t["level"].to_pylist(), t["j"].to_pylist(), strict=True), t["hash"].to_pylist(), strict=True))
        made: dict[tuple[int, int], str] = {}
        merge(known, total, fanout, lambda level, j, x: made.__setitem__((level, j), x))
        rows = [(g, run, *at, x, total, at in known, True) for at, x in made.items()]
        return batch(rows + [(g, run, *at, x, total, True, False) for at, x in known.items() if at not in made], NODE)

    numbered = leaves.join(runs.select("part", "g", "first", "total", "run"), ["part", "g"]).select("part", "g", "pos", "leaf", "first", "total", "run")
    out = common.stored(numbered.groupBy("part", "g").applyInArrow(climb, NODE), "peaks")
    most = runs.agg(F.max("run")).first()[0] or 0
    edges = out.where("edge")
    while most:
        merged = common.stored(edges.groupBy("g", F.floor(F.col("run") / MERGED)).applyInArrow(join, NODE), "merged_peaks")
        out = out.where("fresh or not edge").withColumn("edge", F.lit(False)).unionAll(merged)
        edges, most = merged.where("edge"), most // MERGED
    return out


def around(runs: DataFrame, known: DataFrame, fanout: int) -> DataFrame:
    """Of each run, the nodes of the whole tree that are siblings of a node over its first or last leaf."""
    b = F.lit(fanout)
    level = F.expr(f"sequence(0, cast(ceil(log({fanout}, total)) as int) + 1)")
    at = runs.select("part", "g", "first", "n", F.explode(level).alias("level")).withColumn("step", F.pow(b, F.col("level") + 1).cast("long"))
    parent = [F.floor(x / F.col("step")) for x in (F.col("first"), F.col("first") + F.col("n") - 1)]
    children = [F.sequence(p * b, p * b + b - 1) for p in parent]
    wanted = at.select("part", "g", "level", F.explode(F.array_distinct(F.concat(*children))).alias("j"))
    return wanted.join(known.where("fresh").select("g", "level", "j", "hash"), ["g", "level", "j"]).withColumns({"index": F.lit(None).cast("long"), "total": F.lit(None).cast("long")}).select(*AROUND)


Path = list[tuple[int, list[str]]]


def path(index: int, levels: list[dict[int, str]], count: list[int], fanout: int) -> Path:
    """From the leaf up: the place in its run of each node on the way, and the run."""
    out = []
    for nodes_, size in zip(levels, count[:-1], strict=False):
        first = index // fanout * fanout
        out.append((index - first, [nodes_[j] for j in range(first, min(size, first + fanout))]))
        index //= fanout
    return out


def folded(leaf_: str, way: Path) -> str:
    """The top that ``leaf_`` leads to beside the siblings of ``way``."""
    for place, run in way:
        leaf_ = digest([*run[:place], leaf_, *run[place + 1 :]])
    return leaf_


def walked(leaves: DataFrame, runs: DataFrame, near: DataFrame, fanout: int, rows_of: Callable[[pa.Table, Callable[[int], Path], pa.Table], list[tuple]], schema: str) -> DataFrame:
    """``rows_of`` each run: it gets its leaves in order, the way up from each, and what is ``near`` the run."""

    def walk(t: pa.Table, beside: pa.Table) -> pa.Table:
        if not t.num_rows:
            return batch([], schema)
        t = in_order(t)
        first, total = t["first"][0].as_py(), t["total"][0].as_py()
        count = sizes(total, fanout)
        levels: list[dict[int, str]] = [{} for _ in count]
        for level, j, x in zip(beside["level"].to_pylist(), beside["j"].to_pylist(), beside["hash"].to_pylist(), strict=True):
            if level >= 0:
                levels[level][j] = x
        m = Mountains(first, total, fanout, lambda level, j, x: levels[level].__setitem__(j, x), lambda *_: None)
        for x in t["leaf"].to_pylist():
            m.push(x)
        return batch(rows_of(t, lambda i: path(first + i, levels, count, fanout), beside), schema)

    numbered = leaves.join(runs.select("part", "g", "first", "total"), ["part", "g"])
    return numbered.groupBy("part", "g").cogroup(near.groupBy("part", "g")).applyInArrow(walk, schema)


def top_tree(known: DataFrame, fanout: int) -> DataFrame:
    """The tree over the subroots: of each group the nodes on the levels of its way up, with its ``index``
    and the ``total``; a row without a node where it is alone."""
    tops = known.where("fresh").groupBy("g").agg(F.max_by("hash", "level").alias("leaf"))
    leaves, runs = indexed(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "leaf"), [F.col("name")])
    near = around(runs, common.stored(nodes(leaves, runs, fanout), "top_nodes"), fanout)

    def rows_of(t: pa.Table, way: Callable[[int], Path], beside: pa.Table) -> list[tuple]:
        first, total, out = t["first"][0].as_py(), t["total"][0].as_py(), []
        for i, name in enumerate(t["name"].to_pylist()):
            index = at = first + i
            out.append((name, None, None, None, index, total))
            for level, (place, run) in enumerate(way(i)):
                out += [(name, level, at - place + k, x, index, total) for k, x in enumerate(run)]
                at //= fanout
        return out

    return common.stored(walked(leaves, runs, near, fanout, rows_of, "g string, level int, j long, hash string, index long, total long"), "top_ways")


def proven(leaves: DataFrame, order: list[Column], fanout: int = 2) -> DataFrame:
    """Rows of PROOF of ``leaves`` (doc_id, g, leaf, told): ``told`` is the leaf that is checked."""
    leaves, runs = indexed(leaves, order)
    known = common.stored(nodes(leaves, runs, fanout), "nodes")
    tops = top_tree(known, fanout)
    near = around(runs, known, fanout).unionAll(runs.select("part", "g").join(tops, "g").select("part", "g", (-2 - F.coalesce("level", F.lit(-1))).alias("level"), "j", "hash", "index", "total"))

    def rows_of(t: pa.Table, way: Callable[[int], Path], beside: pa.Table) -> list[tuple]:
        levels: list[dict[int, str]] = []
        at = top = 0
        for level, j, x, index, total in zip(*(beside[c].to_pylist() for c in ("level", "j", "hash", "index", "total")), strict=True):
            if level < 0:
                at, top = index, total
                while len(levels) < -1 - level:
                    levels.append({})
                if level < -1:
                    levels[-2 - level][j] = x
        above = path(at, levels, sizes(top, fanout), fanout)
        out = []
        for i, (doc, own, told) in enumerate(zip(t["doc_id"].to_pylist(), t["leaf"].to_pylist(), t["told"].to_pylist(), strict=True)):
            below = way(i)
            if not i:
                subroot = folded(own, below)
                root = folded(subroot, above)
            proof = digest([x for place, run in below + above for k, x in enumerate(run) if k != place])
            got = folded(told, below + above)
            out.append((doc, own, subroot, root, proof, got, got == root))
        return out

    return walked(leaves, runs, near, fanout, rows_of, PROOF)


def document_leaves(docs: DataFrame) -> DataFrame:
    """A leaf of each row (doc_id, source, lang, n_chars, text), its group by ``lang``, and the leaf ``told``
    of it: another where 7 divides crc32(doc_id), as if its n_chars had been one more."""
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")], F.col("n_chars").cast("long").alias("n_chars"))
    fields = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    changed = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    # null before all: every other group's name begins with a sign
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g")
    out = doc.select("doc_id", group, fields(F.col("n_chars")).alias("leaf"), F.when(changed, fields(F.col("n_chars") + 1)).alias("told"))
    return out.withColumn("told", F.coalesce("told", "leaf"))


def verify(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """The manifest of ``docs`` with the proof of each row, checked against what is told of it."""
    return proven(document_leaves(docs), [F.col("doc_id"), F.col("leaf")], fanout)


def node_records(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """All nodes of the groups' trees: (g, level, j, hash), to be kept as the manifest."""
    leaves, runs = indexed(document_leaves(docs), [F.col("doc_id"), F.col("leaf")])
    return nodes(leaves, runs, fanout, records=True).where("fresh or not edge").select("g", "level", "j", "hash")


#: The same result in DuckDB: both trees level by level, siblings by their places, tampered leaves folded level by level.
ORACLE_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS own, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text] AS other FROM documents),
l AS (
  SELECT doc_id, lang, sha256(array_to_string(list_transform(own, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '')) AS leaf,
         sha256(array_to_string(list_transform(other, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '')) AS changed FROM f),
leaves AS (SELECT doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j, count(*) OVER (PARTITION BY lang) AS n FROM l),
tree AS (
  SELECT coalesce('=' || lang, '') AS g, 0 AS lvl, j, leaf AS h, n FROM leaves
  UNION ALL SELECT g, lvl + 1, j // 2, sha256(string_agg(h, '' ORDER BY j)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, n, j // 2),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS j, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, j, h, n FROM subroots
  UNION ALL SELECT lvl + 1, j // 2, sha256(string_agg(h, '' ORDER BY j)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, n, j // 2),
way AS (
  SELECT x.doc_id, x.leaf, tree.lvl, tree.j < (x.j >> tree.lvl) AS before, tree.h, x.lang, x.j AS place
  FROM leaves x JOIN tree ON tree.g = coalesce('=' || x.lang, '') AND tree.j = xor(x.j >> tree.lvl, 1)
  UNION ALL
  SELECT x.doc_id, x.leaf, 1000 + top.lvl, top.j < (s.j >> top.lvl), top.h, x.lang, x.j
  FROM leaves x JOIN subroots s ON s.g = coalesce('=' || x.lang, '') JOIN top ON top.j = xor(s.j >> top.lvl, 1)),
lone AS (  -- levels where a node is alone in its run, which becomes its own H
  SELECT x.lang, x.j AS place, tree.lvl, tree.n FROM leaves x JOIN tree ON tree.g = coalesce('=' || x.lang, '') AND tree.j = x.j >> tree.lvl WHERE tree.n > 1
  UNION ALL SELECT x.lang, x.j, 1000 + top.lvl, top.n FROM leaves x JOIN subroots s ON s.g = coalesce('=' || x.lang, '') JOIN top ON top.j = s.j >> top.lvl WHERE top.n > 1),
steps AS (
  SELECT lone.lang, lone.place, row_number() OVER (PARTITION BY lone.lang, lone.place ORDER BY lone.lvl) AS k, way.h, way.before
  FROM lone LEFT JOIN way ON way.lang IS NOT DISTINCT FROM lone.lang AND way.place = lone.place AND way.lvl = lone.lvl),
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
told AS (
  SELECT lang, j AS place, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, d: xor(t[(xor(c, d) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 7 = 0 THEN changed ELSE leaf END AS h
  FROM leaves, crc),
fold AS (
  SELECT lang, place, 0 AS k, h FROM told
  UNION ALL SELECT fold.lang, fold.place, steps.k, CASE WHEN steps.h IS NULL THEN sha256(fold.h) WHEN steps.before THEN sha256(steps.h || fold.h) ELSE sha256(fold.h || steps.h) END
  FROM fold JOIN steps ON steps.lang IS NOT DISTINCT FROM fold.lang AND steps.place = fold.place AND steps.k = fold.k + 1),
ended AS (SELECT lang, place, max_by(h, k) AS h FROM fold GROUP BY lang, place),
proofs AS (SELECT lang, place, sha256(string_agg(h, '' ORDER BY lvl)) AS p FROM way GROUP BY lang, place),
root AS (SELECT h FROM top WHERE n = 1)
SELECT x.doc_id, x.leaf, s.h AS subroot, root.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM leaves x CROSS JOIN root JOIN subroots s ON s.g = coalesce('=' || x.lang, '')
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM x.lang AND p.place = x.j JOIN ended e ON e.lang IS NOT DISTINCT FROM x.lang AND e.place = x.j
"""
