"""The dependency graph as tables: nodes (path) and edges (src, dst, edge_type).

Walks are loops over a frontier: each hop joins the frontier with the edges, drops what was seen, and
is written to the shared folder; a hop costs its frontier's edges, and no path or node set comes to
the driver. Only a graph that is known to have ``SMALL`` edges at most, as most source trees do, is
walked on the driver, where a hop costs no job.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import stored, stored_counted


#: Edges and sources of a graph that is walked on the driver.
SMALL = 20_000
#: Paths of a length that a search follows at once.
BLOCK = 1000
#: Edges of a range that a task looks at together.
EDGES = 200_000


def _rows(table: DataFrame) -> list[tuple] | None:
    """All rows, if there are SMALL at most; else None."""
    found = table.limit(SMALL + 1).collect()
    return None if len(found) > SMALL else [tuple(r) for r in found]


def edges(imports: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Distinct edges without loops; where an import and a symbol join the same files, the import
    names the edge."""
    out = imports.select("src", "dst", F.lit("import").alias("edge_type"))
    if references is not None:
        out = out.unionByName(references.select(F.col("used_in").alias("src"), F.col("defined_in").alias("dst"), F.lit("symbol_ref").alias("edge_type")))
    return out.where("src <> dst").groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type"))


def degrees(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Rows (path, fan_in, fan_out) of all nodes, from one shuffle of the edges' ends."""
    ends = edges_.select(F.explode(F.array(F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    all_ = ends.unionByName(nodes.select("path", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return all_.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).join(nodes.select("path").distinct(), "path", "left_semi")


def entry_points(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes with an entry's name; if there are none, those of least fan-in."""
    named = nodes.where(paths.is_entry(F.col("path"))).select("path")
    if not named.isEmpty():
        return named
    deg = degrees(nodes, edges_).select("path", "fan_in")
    least = deg.agg(F.min("fan_in").alias("least"))
    return deg.join(F.broadcast(least), deg["fan_in"] == least["least"]).select("path")


def distances(edges_: DataFrame, sources: DataFrame, both_ways: bool = True, max_hops: int | None = None, target: str | None = None) -> DataFrame:
    """Rows (path, dist): hops from the nearest of ``sources`` (path), along edges or along both ways;
    what can't be reached has no row. Ends early once ``target`` is reached."""
    steps = edges_.select("src", "dst")
    if both_ways:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    steps = stored(steps.distinct(), "steps")
    if (known := _rows(steps)) is not None and (starts := _rows(sources.select("path").distinct())) is not None:
        return edges_.sparkSession.createDataFrame(_near(known, [p for (p,) in starts], max_hops, target), "path string, dist int")
    found = F.col("path") == target if target is not None else F.lit(False)
    first, (n, hit) = stored_counted(sources.select("path").distinct().withColumn("dist", F.lit(0)), "frontier", F.lit(True), found)
    hops = [first]
    while n and not hit and (max_hops is None or len(hops) <= max_hops):
        ahead = steps.join(hops[-1].select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct()
        # along both ways a step leads no further back than to the hop before
        known = reduce(DataFrame.unionByName, hops[-2:] if both_ways else hops)
        new, (n, hit) = stored_counted(ahead.join(known, "path", "left_anti").withColumn("dist", F.lit(len(hops))), "frontier", F.lit(True), found)
        hops.append(new)
    return reduce(DataFrame.unionByName, hops)


def _near(steps: list[tuple[str, str]], starts: list[str], max_hops: int | None, target: str | None) -> list[tuple[str, int]]:
    """``distances`` of a small graph."""
    ahead: dict[str, list[str]] = {}
    for a, b in steps:
        ahead.setdefault(a, []).append(b)
    dist, frontier, hop = dict.fromkeys(starts, 0), starts, 0
    while frontier and (max_hops is None or hop < max_hops) and (target is None or target not in dist):
        hop += 1
        frontier = list({b for a in frontier for b in ahead.get(a, ()) if b not in dist})
        dist |= dict.fromkeys(frontier, hop)
    return list(dist.items())


def distance(edges_: DataFrame, source: str, target: str) -> int | None:
    """Hops along edges from one node to another; None if there is no way."""
    start = edges_.sparkSession.createDataFrame([(source,)], "path string")
    found = distances(edges_, start, both_ways=False, target=target).where(F.col("path") == target).first()
    return found["dist"] if found else None


def cyclic(edges_: DataFrame) -> DataFrame:
    """Nodes (path) on a cycle: those of strongly connected components of two nodes or more.

    Files of a folder import each other most, and so do nodes of near names in general. So edges are first
    sorted by name in ranges, and each task settles what is known there (``_ranges``); nodes without a way
    in or out are trimmed, and what is left goes round again, as long as that halves it. The rest, if it
    is large, is searched by colors.
    """
    left, before, found = edges_.where("src <> dst").select("src", "dst"), float("inf"), []
    while True:
        done, (n,) = stored_counted(_ranges(left), "ranges", F.col("dst").isNotNull())
        found.append(done.where("dst is null").select(F.col("src").alias("path")))
        left = done.where("dst is not null")
        if n <= SMALL:
            found.append(edges_.sparkSession.createDataFrame([(p,) for p in _on_cycles(_rows(left))], "path string"))
        elif 2 * n > before:
            found.append(_by_colors(left, n))
        if n <= SMALL or 2 * n > before:
            return reduce(DataFrame.unionByName, found)
        left, before = _trimmed(left), n


def _ranges(edges_: DataFrame) -> DataFrame:
    """Nodes that are on a cycle, as rows (src, null), and edges that may be, of which they and all that leads
    nowhere else are left out. A task has all ways out of its range's nodes, so what can't leave the range
    can't be on a cycle beyond it. It holds ``EDGES`` edges or so at once, as a smaller range; a node with
    more goes through as it is."""

    def settled(pairs: dict[tuple[str, str], None], lo: str, hi: str) -> tuple[list[str], list[tuple[str, str]]]:
        behind: dict[str, list[str]] = {}
        leaving = []
        for a, b in pairs:
            if lo <= b <= hi:
                behind.setdefault(b, []).append(a)
            else:
                leaving.append(a)
        leads = set(leaving)
        while leaving:
            new = [a for a in behind.get(leaving.pop(), ()) if a not in leads]
            leads.update(new)
            leaving += new
        return _on_cycles([x for x in pairs if x[0] not in leads]), [x for x in pairs if x[0] in leads and (x[1] in leads or not lo <= x[1] <= hi)]

    def batch(on: list[str], pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*on, *(a for a, _ in pairs)], pa.string()), pa.array([*[None] * len(on), *(b for _, b in pairs)], pa.string())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], None] = {}
        large = last = None
        for b in batches:
            if not b.num_rows:
                continue
            src, dst = b.column(0).to_pylist(), b.column(1).to_pylist()
            last = src[-1]
            held.update(dict.fromkeys(zip(src, dst, strict=True)))
            if len(held) < EDGES:
                continue
            whole = {x: None for x in held if x[0] != last and x[0] != large}
            if past := [x for x in held if x[0] == large]:
                yield batch([], past)
            if whole:
                yield batch(*settled(whole, next(iter(whole))[0], next(reversed(whole))[0]))
            held = {x: None for x in held if x[0] == last and last != large}
            if len(held) >= EDGES:
                yield batch([], list(held))
                held, large = {}, last
        whole = {x: None for x in held if x[0] != large}
        if past := [x for x in held if x[0] == large]:
            yield batch([], past)
        if whole:
            yield batch(*settled(whole, next(iter(whole))[0], next(reversed(whole))[0]))

    return edges_.repartitionByRange("src").sortWithinPartitions("src", "dst").mapInArrow(run, "src string, dst string")


def _trimmed(edges_: DataFrame) -> DataFrame:
    """Edges without nodes that have no way in or none out, twice over."""
    for _ in range(2):
        ins, outs = edges_.select(F.col("dst").alias("src")).distinct(), edges_.select(F.col("src").alias("dst")).distinct()
        edges_ = edges_.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst")
    return edges_


def _by_colors(left: DataFrame, n: int) -> DataFrame:
    """``cyclic`` of a graph of ``n`` edges without near names, which may come twice.

    Nodes without a way in or out are trimmed until none is left. Then each node takes the greatest
    name that reaches it, and with each step also the name that its name's node has by then, so that
    names don't have to walk long ways edge by edge; from the nodes that kept their own, the walk back
    among equal names finds their components, which are taken out. What is left goes round again.
    """
    found = left.select(F.col("src").alias("path")).limit(0)
    while True:
        before = -1
        while n and before != n:
            before = n
            left, (n,) = stored_counted(_trimmed(left), "left")
        if not n:
            return found.distinct()
        color, up = stored(left.select(F.col("src").alias("path")).distinct().withColumn("color", F.col("path")), "color"), 1
        while up:
            new = color.withColumn("was", F.col("color"))
            for _ in range(2):
                came = left.join(new.select(F.col("path").alias("src"), "color"), "src").groupBy(F.col("dst").alias("path")).agg(F.max("color").alias("c"))
                new = new.join(came, "path", "left").select("path", F.greatest("color", "c").alias("color"), "was")
            further = color.select(F.col("path").alias("color"), F.col("color").alias("c"))
            new = new.join(further, "color").select("path", F.greatest("color", "c").alias("color"), "was")
            new, (up,) = stored_counted(new, "color", F.col("color") > F.col("was"))
            color = new.drop("was")
        of = color.withColumnsRenamed({"path": "src", "color": "a"})
        same = stored(left.join(of, "src").join(color.withColumnsRenamed({"path": "dst", "color": "b"}), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "same")
        roots = color.where("path = color").select("path")
        own = stored(distances(same, roots, both_ways=False).select("path").join(color, "path"), "own")
        large = own.groupBy("color").count().where("count > 1").select("color")
        found = stored(found.unionByName(own.join(large, "color", "left_semi").select("path")), "found")
        left, (n,) = stored_counted(left.join(own.select(F.col("path").alias("src")), "src", "left_anti").join(own.select(F.col("path").alias("dst")), "dst", "left_anti"), "left")


def _on_cycles(steps: list[tuple[str, str]]) -> list[str]:
    """``cyclic`` of a small graph, by one walk that keeps what is still open (Tarjan)."""
    ahead: dict[str, list[str]] = {}
    for a, b in steps:
        ahead.setdefault(a, []).append(b)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    held: set[str] = set()
    out: list[str] = []
    for start in ahead:
        work = [] if start in number else [(start, iter(ahead[start]))]
        while work:
            node, after = work[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                open_.append(node)
                held.add(node)
            for b in after:
                if b not in number:
                    work.append((b, iter(ahead.get(b, ()))))
                    break
                if b in held:
                    low[node] = min(low[node], number[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(open_.pop())
                    held.difference_update(own)
                    out += own if len(own) > 1 else []
    return out


def _paths(steps: list[tuple], starts: list[str], max_depth: int, max_paths: int) -> list[list[str]] | None:
    """``call_paths`` of a small graph with SMALL ways at most from its entries; None if there are more."""
    ahead: dict[str, list[tuple]] = {}
    for a, b, step in steps:
        ahead.setdefault(a, []).append((tuple(step), b))
    ways = dict.fromkeys(starts, 1)
    for _ in range(max_depth - 1):
        new: dict[str, int] = {}
        for a, n in ways.items():
            for _, b in ahead.get(a, ()):
                new[b] = new.get(b, 0) + n
        ways = new
        if sum(ways.values()) > SMALL:
            return None
    done: list[list[str]] = []
    for start in starts:
        level: list[tuple[list, list[str]]] = [([], [start])]
        for size in range(1, max_depth + 1):
            grown, ended = [], []
            for trail, nodes in sorted(level):
                more = [([*trail, step], [*nodes, b]) for step, b in ahead.get(nodes[-1], ()) if b not in nodes] if size < max_depth else []
                grown += more
                ended += [] if more else [nodes]
            done += ended[: max_paths - len(done)]
            level = grown
        if len(done) == max_paths:
            break
    return done


def call_paths(edges_: DataFrame, entries: DataFrame, max_depth: int = 5, max_paths: int = 3) -> DataFrame:
    """Rows (rank, nodes): paths from entries to where they can't go on, or ``max_depth`` nodes.

    Entries go in the order of their names. Within one, shorter paths end first, and of equal length
    those over nodes of more fan-in, then of lesser name. The first ``max_paths`` of all count; they
    are given longest first. As every entry has a path, only the first ``max_paths`` entries are
    followed, one after the other, and only until enough paths have ended. Steps are rows, so no
    node's successors are gathered, and no more than ``BLOCK`` paths of a length are held.
    """
    spark = edges_.sparkSession
    fan = edges_.groupBy(F.col("dst").alias("d")).agg(F.count("*").alias("fan"))
    step = F.struct((-F.col("fan")).alias("k"), F.col("dst").alias("n"))
    steps = stored(edges_.select("src", "dst").distinct().join(fan, F.col("dst") == F.col("d")).select("src", "dst", step.alias("step")), "steps")
    starts = [r["path"] for r in entries.select("path").distinct().orderBy("path").limit(max_paths).collect()]
    done: list[list[str]] = []
    if (known := _rows(steps)) is not None and (found := _paths(known, starts, max_depth, max_paths)) is not None:
        done, starts = found, []
    if starts:
        done = _search(steps, starts, max_depth, max_paths)
    done.sort(key=lambda x: (-len(x), x))
    return spark.createDataFrame([(i, x) for i, x in enumerate(done, 1)], "rank int, nodes array<string>")


_TRAIL = "nodes array<string>, trail array<struct<k: bigint, n: string>>"


def _search(steps: DataFrame, starts: list[str], max_depth: int, max_paths: int) -> list[list[str]]:
    """``call_paths`` of any graph, depth first in blocks: of the ways on from a block of paths the first
    ``BLOCK`` in order are followed to their end before the next are looked at, so that no more is held of
    any level. Only nodes are entered from which as many steps as are left lead to a node that a path can end
    at: one with so few successors that a path can hold them all, or any node at ``max_depth``."""
    spark = steps.sparkSession
    pairs = stored(steps.select("src", "dst"), "ways")
    ends = pairs.select(F.col("dst").alias("node")).distinct().join(pairs.groupBy("src").count().where(F.col("count") > max_depth - 2), F.col("node") == F.col("src"), "left_anti")
    ahead: dict[bool, list[DataFrame]] = {True: [stored(ends, "ends")], False: [pairs.select(F.col("dst").alias("node")).distinct()]}
    for some in ahead.values():
        for _ in range(max_depth - 2):
            some.append(stored(pairs.join(some[-1], F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node")).distinct(), "ahead"))

    def frame(paths: list[tuple]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([tuple(x) for x in paths], _TRAIL))  # BLOCK rows

    def grown(paths: list[tuple]) -> DataFrame:
        return steps.join(frame(paths), F.element_at("nodes", -1) == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))

    def follow(paths: list[tuple], size: int, need: int) -> list[list[str]]:
        """The first paths of ``size`` nodes that ``paths`` become and that end there."""
        if not paths:
            return []
        at = len(paths[0][0])
        if at == size:
            on = {tuple(r["nodes"]) for r in grown(paths).select("nodes").distinct().collect()} if size < max_depth else set()  # of BLOCK paths
            return [list(nodes) for nodes, _ in paths if tuple(nodes) not in on][:need]
        out: list[list[str]] = []
        after = None
        while len(out) < need:
            more = grown(paths).join(ahead[size < max_depth][size - at - 1], F.col("dst") == F.col("node"), "left_semi").select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("trail", F.array("step")).alias("trail"))
            if after is not None:
                more = more.where(F.col("trail") > F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(n).alias("n")) for k, n in after]))
            block = more.orderBy("trail").limit(BLOCK).collect()
            out += follow([tuple(r) for r in block], size, need - len(out))
            if len(block) < BLOCK:
                break
            after = block[-1]["trail"]
        return out

    done: list[list[str]] = []
    for start in starts:
        for size in range(1, max_depth + 1):
            done += follow([([start], [])], size, max_paths - len(done))
            if len(done) == max_paths:
                return done
    return done


def importers(edges_: DataFrame) -> DataFrame:
    """Rows (path, importer): who imports each file, as a relation, so that no file gathers them."""
    return edges_.where("edge_type = 'import'").select(F.col("dst").alias("path"), F.col("src").alias("importer")).distinct()


def counts(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """One row (nodes, edges)."""
    return nodes.select("path").distinct().agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(edges_.agg(F.count("*").alias("edges"))))  # one row each


def cycles(edges_: DataFrame, on_cycles: DataFrame, longest: int = 5, n: int = 25) -> DataFrame:
    """Rows (nodes): the first ``n`` simple cycles of ``longest`` nodes at most, shorter ones first, then
    by names; each once, from its least node on. Only edges between nodes ``on_cycles`` are walked, and
    no longer cycles than are needed."""
    spark = edges_.sparkSession
    own = edges_.select("src", "dst").where("src <> dst").distinct().join(on_cycles.select(F.col("path").alias("src")), "src", "left_semi").join(on_cycles.select(F.col("path").alias("dst")), "dst", "left_semi")
    own = stored(own, "cycle_edges")
    back = own.select(F.col("src").alias("b"), F.col("dst").alias("a"))

    def closing(paths: DataFrame, need: int) -> list[list[str]]:
        both = paths.join(back, (F.element_at("nodes", -1) == F.col("b")) & (F.col("nodes")[0] == F.col("a")))
        return [list(r["nodes"]) for r in both.select("nodes").orderBy("nodes").limit(need).collect()]

    def follow(paths: list[list[str]], size: int, need: int) -> list[list[str]]:
        """The first cycles of ``size`` nodes that begin with one of ``paths``, depth first in blocks: of the
        ways on from these the first ``BLOCK`` are followed to their end before the next."""
        out: list[list[str]] = []
        after: list[str] | None = None
        while len(out) < need:
            if paths:
                some = F.broadcast(spark.createDataFrame([(x,) for x in paths], "nodes array<string>"))  # BLOCK rows
                more = own.join(some, F.element_at("nodes", -1) == F.col("src")).where((F.col("dst") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("dst"))).select(F.concat("nodes", F.array("dst")).alias("nodes"))
            else:
                more = own.where("src < dst").select(F.array("src", "dst").alias("nodes"))
            if len(paths[0] if paths else [0]) + 1 == size:
                return closing(more, need)
            if after is not None:
                more = more.where(F.col("nodes") > F.array(*map(F.lit, after)))
            block = [list(r["nodes"]) for r in more.orderBy("nodes").limit(BLOCK).collect()]
            if block:
                out += follow(block, size, need - len(out))
            if len(block) < BLOCK:
                break
            after = block[-1]
        return out

    found: list[list[str]] = []
    for size in range(2, longest + 1):
        found += follow([], size, n - len(found))
        if len(found) == n:
            break
    return spark.createDataFrame([(x,) for x in found], "nodes array<string>")


def top_edges(ranked: DataFrame, edges_: DataFrame, n: int) -> DataFrame:
    """Rows (src_id, dst_id): edges between the ``n`` best of ``ranked`` (path, score), as their places
    from 0."""
    top = ranked.orderBy(F.desc("score"), "path").limit(n)
    top = F.broadcast(top.select("path", (F.row_number().over(Window.orderBy(F.desc("score"), "path")) - 1).alias("id")))  # n rows
    a, b = top.withColumnsRenamed({"path": "src", "id": "src_id"}), top.withColumnsRenamed({"path": "dst", "id": "dst_id"})
    return edges_.join(a, "src").join(b, "dst").select("src_id", "dst_id", "src", "dst")
