"""The operators over the test tables, each with the same result in DuckDB's SQL.

Adapters turn tables into what the operators take: documents into files, suppliers into ranked
entities, trade between nations into a dependency graph, events into a change log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import globs, paths
from ..functions import text as tx
from ..operators import budget, extract, graph, rank, render, report, resolve, semantic, vectors
from ..sources import cache, repo_files
from ..storage import stored
from ..streaming import debounce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


# -- adapters ---------------------------------------------------------------------------------------


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """Edges (src, dst): each nation's customers buy from; the three most frequent others."""
    from pyspark.sql import Window

    t = lambda n: table(spark, sf, n)
    flow = (
        t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    )
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "s_nationkey"))
    return stored(flow.withColumn("k", k).where("k <= 3").select(F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst")), "trade")


TRADE = """flow AS (
  SELECT c_nationkey, s_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
e AS (SELECT CAST(c_nationkey AS VARCHAR) AS src, CAST(s_nationkey AS VARCHAR) AS dst
      FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, s_nationkey) AS k FROM flow) WHERE k <= 3),
nodes AS (SELECT CAST(n_nationkey AS VARCHAR) AS path FROM nation)"""
WALK = """u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
walk AS (SELECT '0' AS path, 0 AS dist UNION SELECT u.dst, dist + 1 FROM walk JOIN u ON path = src WHERE dist < 24),
near AS (SELECT path, min(dist) AS dist FROM walk GROUP BY path),
reach AS (SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON reach.dst = e.src),
cyc AS (SELECT DISTINCT src AS path FROM reach WHERE src = dst)"""


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("path"))


def suppliers(spark: SparkSession, sf: str, task: str) -> DataFrame:
    """Signals of suppliers as ranked entities."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = [F.count("*").alias("freq"), F.max(seconds(F.col("l_shipdate"))).alias("last_ts"), F.count_distinct("l_partkey").alias("symbols"), F.count_distinct("o_custkey").alias("fan_in")]
    sold = stored(line.groupBy("l_suppkey").agg(*own), "sold")
    as_of = sold.agg(F.max("last_ts").alias("t")).first()["t"]
    edges = trade(spark, sf)
    near = graph.distances(edges, spark.createDataFrame([("0",)], "path string")).select(F.col("path").alias("nation"), "dist")
    cyclic = graph.cyclic(edges).select(F.col("path").alias("nation"), F.lit(True).alias("cyclic"))
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), "s_suppkey", "s_nationkey", F.col("s_nationkey").cast("string").alias("nation"))
    rows = rows.join(sold, F.col("s_suppkey") == sold["l_suppkey"], "left").drop("l_suppkey")
    rows = rows.join(near, "nation", "left").join(cyclic, "nation", "left")
    days = rank.days_since(F.col("last_ts"), as_of)
    return rows.select("path", "s_suppkey", "s_nationkey", "freq", "fan_in", rank.recency(days, task).alias("recency"), rank.nearness(F.col("dist")).alias("proximity"), "symbols", (F.lit(1.0) / (F.lit(1.0) + F.col("s_nationkey") % 4)).alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def supplier_sql(task: str, semantic_: bool = False) -> str:
    w = config.weights(task, semantic_)
    used = [s for s in config.SIGNALS if w[s]]
    scaled = ", ".join(f"CASE WHEN max({s}) OVER () > min({s}) OVER () THEN ({s} - min({s}) OVER ()) / (max({s}) OVER () - min({s}) OVER ()) ELSE 0.0::DOUBLE END AS {s}" for s in used)
    total = " + ".join(f"{w[s]!r}::DOUBLE * {s}" for s in used) + (f" + {config.SEMANTIC_WEIGHT!r}::DOUBLE * relevance" if semantic_ else "")
    days = "coalesce(greatest((max(last_ts) OVER () - last_ts) / 86400.0::DOUBLE, 0.0::DOUBLE), 365.0::DOUBLE)"
    recency = days if task == "refactor" else f"1.0::DOUBLE / (1.0::DOUBLE + {days})"
    return f"""WITH RECURSIVE {TRADE}, {WALK},
li AS (SELECT l_suppkey, count(*)::DOUBLE AS freq, max(epoch(l_shipdate)) AS last_ts, count(DISTINCT l_partkey)::DOUBLE AS symbols, count(DISTINCT o_custkey)::DOUBLE AS fan_in
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey),
sig AS (SELECT 's' || s_suppkey AS path, s_suppkey, s_nationkey, coalesce(freq, 0.0::DOUBLE) AS freq, coalesce(fan_in, 0.0::DOUBLE) AS fan_in, {recency} AS recency,
               coalesce(1.0::DOUBLE / (1.0::DOUBLE + dist::DOUBLE), 0.0::DOUBLE) AS proximity, coalesce(symbols, 0.0::DOUBLE) AS symbols, 1.0::DOUBLE / (1.0::DOUBLE + (s_nationkey % 4)) AS depth, cyc.path IS NOT NULL AS cyclic
               {", relevance" if semantic_ else ""}
        FROM supplier LEFT JOIN li ON s_suppkey = l_suppkey LEFT JOIN near ON near.path = CAST(s_nationkey AS VARCHAR) LEFT JOIN cyc ON cyc.path = CAST(s_nationkey AS VARCHAR)
        {"LEFT JOIN rel ON s_suppkey = vec_id" if semantic_ else ""}),
norm AS (SELECT path, s_suppkey, s_nationkey, cyclic, {"coalesce(relevance, 0.0::DOUBLE) AS relevance, " if semantic_ else ""}{scaled} FROM sig),
scored AS (SELECT path, s_suppkey, s_nationkey, round(least(greatest({total} - CASE WHEN cyclic THEN {config.CYCLE_PENALTY!r}::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS score FROM norm),
lim AS (SELECT list(score ORDER BY score DESC) AS s FROM scored),
tiered AS (SELECT path, s_suppkey, s_nationkey, score, CASE WHEN score >= s[greatest(1, floor(len(s) * 0.15::DOUBLE))::INT] THEN 1 WHEN score >= s[least(greatest(2, floor(len(s) * 0.45::DOUBLE)), len(s))::INT] THEN 2 ELSE 3 END AS tier FROM scored, lim)
"""


REL = """q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
far AS (SELECT vec_id, label, 1.0::DOUBLE - greatest(least(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 1.0::DOUBLE), -1.0::DOUBLE) AS d FROM embeddings, q),
rel AS (SELECT vec_id, label, round(greatest(1.0::DOUBLE - d / CASE WHEN max(d) OVER () = 0 THEN 1.0::DOUBLE ELSE max(d) OVER () END, 0.0::DOUBLE), 6) AS relevance FROM far)"""


def scores(spark: SparkSession, sf: str, task: str = "default") -> DataFrame:
    return stored(rank.score(stored(suppliers(spark, sf, task), "signals"), task), "scores")


def relevances(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return semantic.relevance(vectors, vectors.where("vec_id = 0").first()["embedding"])


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files."""
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text", F.col("lang").alias("language"), "n_chars")


FILES = "f AS (SELECT doc_id, concat_ws('/', source, lang, doc_id || '.txt') AS path, text, lang AS language, n_chars FROM documents)"

#: Folders and names that paths of every kind are made of.
FOLDERS = ("src/pkg", "tests", "docs/guide", "build", "lib/node_modules/x", ".venv/bin", "pkg/config", ".")
NAMES = ("main.py", "app.log", ".env", "id_rsa", "package.json", "data.json", "util.ts", "README.md", "key.pem", "x.lock", "a.YAML", "service-account-1.json", "Makefile", "mod.rs", "x.test.JS", "noext")


def varied(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % len(FOLDERS) + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.floor(F.col("doc_id") / len(FOLDERS)) % len(NAMES) + 1).cast("int"))
    path = F.when(folder == ".", name).otherwise(F.concat(folder, F.lit("/"), name))
    return table(spark, sf, "documents").select("doc_id", path.alias("path"))


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
VARIED = f"""v0 AS (SELECT doc_id, {_list(FOLDERS)}[doc_id % {len(FOLDERS)} + 1] AS folder, {_list(NAMES)}[(doc_id // {len(FOLDERS)}) % {len(NAMES)} + 1] AS name FROM documents),
v AS (SELECT doc_id, CASE WHEN folder = '.' THEN name ELSE folder || '/' || name END AS path, folder, name, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix FROM v0)"""


# -- ranking, tiers, budget -------------------------------------------------------------------------

for _task in config.PROFILES:
    query(supplier_sql(_task) + "SELECT path, score, tier FROM tiered", f"rank_{_task}")(lambda spark, sf, t=_task: rank.tiers(scores(spark, sf, t)).select("path", "score", "tier"))


@query(supplier_sql("default", True).replace("WITH RECURSIVE ", f"WITH RECURSIVE {REL}, ", 1) + "SELECT path, score, tier FROM tiered")
def rank_semantic(spark, sf):
    near = relevances(spark, sf).select(F.col("vec_id").alias("s_suppkey"), "relevance")
    return rank.tiers(rank.score(suppliers(spark, sf, "default").join(near, "s_suppkey", "left"), semantic=True)).select("path", "score", "tier")


@query(supplier_sql("default") + "SELECT path, score, CASE WHEN s_nationkey % 5 = 0 THEN 3 ELSE tier END AS tier FROM tiered")
def tiers_override(spark, sf):
    return rank.tiers(scores(spark, sf), F.col("s_nationkey") % 5 == 0).select("path", "score", "tier")


@query(supplier_sql("default") + "SELECT path, score, tier, row_number() OVER (ORDER BY score DESC, path) AS place FROM tiered QUALIFY place <= 40")
def ranked_top40(spark, sf):
    from pyspark.sql import Window

    top = rank.tiers(scores(spark, sf)).orderBy(F.desc("score"), "path").limit(config.RANKED_ROWS)
    return top.select("path", "score", "tier", F.row_number().over(Window.orderBy(F.desc("score"), "path")).cast("long").alias("place"))


def charged_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stored(rank.tiers(scores(spark, sf)).select("path", "score", "tier", (F.lit(10) + F.col("s_suppkey") * 37 % 91).alias("tokens")), "charged_rows")


COSTS = "c AS (SELECT path, score, tier, 10 + s_suppkey * 37 % 91 AS tokens FROM tiered)"
WHOLE = "b AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY tier, score DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE tier < 3)"


@query(supplier_sql("default") + f", {COSTS}, {WHOLE} SELECT path, tier, tokens, CAST(least(tokens, 1500 - before) AS BIGINT) AS charged FROM b WHERE before < 1500")
def budget_prefix(spark, sf):
    return budget.fill_whole(charged_rows(spark, sf), 1500).select("path", "tier", "tokens", "charged")


@query(
    supplier_sql("default")
    + f""", {COSTS}, {WHOLE}, lft AS (SELECT 4000 - coalesce(sum(least(tokens, 4000 - before)), 0) AS r FROM b WHERE before < 4000),
o AS (SELECT path, tier, tokens, row_number() OVER (ORDER BY score DESC, path) AS k FROM c WHERE tier = 3),
g AS (SELECT 0::BIGINT AS k, r::BIGINT AS r, NULL::VARCHAR AS path, NULL::INTEGER AS tier, 0::BIGINT AS tokens, false AS taken FROM lft
      UNION ALL SELECT o.k, CASE WHEN o.tokens <= g.r AND g.r > 0 THEN g.r - o.tokens ELSE g.r END, o.path, o.tier, o.tokens, o.tokens <= g.r AND g.r > 0 FROM g JOIN o ON o.k = g.k + 1)
SELECT path, tier, tokens, CAST(least(tokens, 4000 - before) AS BIGINT) AS charged FROM b WHERE before < 4000 UNION ALL SELECT path, tier, tokens, tokens AS charged FROM g WHERE taken"""
)
def budget_greedy(spark, sf):
    return budget.fill(charged_rows(spark, sf), 4000).select("path", "tier", "tokens", "charged")


@query(supplier_sql("default") + f", {COSTS} SELECT 7::BIGINT + count(*) AS total_files, count(*) AS included_files, sum(tokens)::BIGINT AS total_tokens, count(*) FILTER (WHERE tier = 1) AS core_count, count(*) FILTER (WHERE tier = 2) AS supporting_count, count(*) FILTER (WHERE tier = 3) AS peripheral_count FROM c")
def run_stats(spark, sf):
    rows = charged_rows(spark, sf).withColumnRenamed("tokens", "token_count")
    return report.statistics(rows, rows.count() + 7)


# -- graph ------------------------------------------------------------------------------------------


@query(f"WITH {TRADE} SELECT src, dst, 'import' AS edge_type FROM e UNION ALL SELECT dst, src, 'symbol_ref' FROM e WHERE (dst, src) NOT IN (SELECT (src, dst) FROM e)")
def edges(spark, sf):
    e = trade(spark, sf)
    return graph.edges(e.unionByName(e).unionByName(e.select("src", F.col("src").alias("dst"))), e.select(F.col("src").alias("defined_in"), F.col("dst").alias("used_in")))


@query(f"WITH {TRADE} SELECT path, (SELECT count(*) FROM e WHERE dst = path) AS fan_in, (SELECT count(*) FROM e WHERE src = path) AS fan_out FROM nodes")
def fan_in_out(spark, sf):
    return graph.degrees(nations(spark, sf), trade(spark, sf))


@query(f"WITH {TRADE}, d AS (SELECT path, (SELECT count(*) FROM e WHERE dst = path) AS n FROM nodes) SELECT path FROM d WHERE n = (SELECT min(n) FROM d)")
def entry_fallback(spark, sf):
    return graph.entry_points(nations(spark, sf), trade(spark, sf))


@query(f"WITH {VARIED} SELECT DISTINCT path FROM v WHERE name = 'main.py'")
def entry_names(spark, sf):
    nodes = varied(spark, sf).select("path").distinct()
    return graph.entry_points(nodes, nodes.select(F.col("path").alias("src"), F.col("path").alias("dst")))


@query(f"WITH RECURSIVE {TRADE}, {WALK.replace("SELECT '0' AS path, 0 AS dist UNION", "SELECT path, 0 AS dist FROM nodes WHERE path IN ('0', '7', '19') UNION")} SELECT path, dist FROM near")
def bfs_undirected(spark, sf):
    return graph.distances(trade(spark, sf), spark.createDataFrame([("0",), ("7",), ("19",)], "path string"))


@query(f"WITH RECURSIVE {TRADE}, w AS (SELECT '0' AS path, 0 AS dist UNION SELECT e.dst, dist + 1 FROM w JOIN e ON path = src WHERE dist < 24) SELECT path, min(dist) AS dist FROM w GROUP BY path")
def bfs_directed(spark, sf):
    return graph.distances(trade(spark, sf), spark.createDataFrame([("0",)], "path string"), both_ways=False)


@query(f"WITH RECURSIVE {TRADE}, {WALK} SELECT path FROM cyc")
def cyclic_nodes(spark, sf):
    return graph.cyclic(trade(spark, sf))


@query(f"""WITH RECURSIVE {TRADE}, fan AS (SELECT dst, count(*) AS n FROM e GROUP BY dst),
s AS (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY n DESC, e.dst) AS k FROM e JOIN fan ON e.dst = fan.dst),
p AS (SELECT ['0'] AS nodes, []::BIGINT[] AS ord UNION ALL SELECT list_append(nodes, s.dst), list_append(ord, s.k) FROM p JOIN s ON nodes[-1] = s.src WHERE len(nodes) < 5 AND NOT list_contains(nodes, s.dst)),
ended AS (SELECT * FROM p WHERE len(nodes) = 5 OR NOT EXISTS (SELECT 1 FROM e WHERE src = nodes[-1] AND NOT list_contains(nodes, dst))),
top AS (SELECT nodes FROM ended ORDER BY len(nodes), ord LIMIT 3)
SELECT CAST(row_number() OVER (ORDER BY len(nodes) DESC, nodes) AS INTEGER) AS rank, array_to_string(nodes, ' -> ') AS chain FROM top""")
def call_paths(spark, sf):
    return graph.call_paths(trade(spark, sf), spark.createDataFrame([("0",)], "path string")).select("rank", F.array_join("nodes", " -> ").alias("chain"))


@query(f"WITH {TRADE}, d AS (SELECT path, (SELECT count(*) FROM e WHERE dst = path) AS n FROM nodes), t AS (SELECT path, CAST(row_number() OVER (ORDER BY n DESC, path) - 1 AS INTEGER) AS id FROM d QUALIFY id < 10) SELECT a.id AS src_id, b.id AS dst_id, src, dst FROM e JOIN t a ON src = a.path JOIN t b ON dst = b.path")
def mermaid_edges(spark, sf):
    e = trade(spark, sf)
    return graph.top_edges(graph.degrees(nations(spark, sf), e).select("path", F.col("fan_in").alias("score")), e, 10)


#: Orders and the parts they buy, both ways.
BOUGHT = "b AS (SELECT DISTINCT 'o' || l_orderkey AS o, 'p' || l_partkey AS p FROM lineitem), u AS (SELECT o AS src, p AS dst FROM b UNION ALL SELECT p, o FROM b)"


@query(f"""WITH {BOUGHT}, h0 AS (SELECT 'p0' AS path), h1 AS (SELECT DISTINCT dst AS path FROM u JOIN h0 ON src = path), h2 AS (SELECT DISTINCT dst AS path FROM u JOIN h1 ON src = path), h3 AS (SELECT DISTINCT dst AS path FROM u JOIN h2 ON src = path),
a AS (SELECT path, 0 AS dist FROM h0 UNION ALL SELECT path, 1 FROM h1 UNION ALL SELECT path, 2 FROM h2 UNION ALL SELECT path, 3 FROM h3) SELECT path, CAST(min(dist) AS INTEGER) AS dist FROM a GROUP BY path""")
def bfs_orders(spark, sf):
    """Hops from a part over all orders and parts: an edge for each line, walked in jobs beyond ``graph.SMALL``."""
    line = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return graph.distances(line, spark.createDataFrame([("p0",)], "path string"), max_hops=3)


RINGS = """l AS (SELECT l_orderkey AS k, l_linenumber AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"""


@query(f"WITH {RINGS} SELECT k || '-' || r AS path FROM l WHERE k % 2 = 0 AND n > 1")
def cyclic_lines(spark, sf):
    """Lines on a cycle: of each order they lead from one to the next, in every second order also from the last to
    the first; and from an order's first line a way leads to the next order's, in every fourth."""
    from pyspark.sql import Window

    own = Window.partitionBy("k")
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).repartition("k").distinct()  # one shuffle, for the windows too
    line = line.select("k", F.row_number().over(own.orderBy("i")).alias("r"), F.count("*").over(own).alias("n"))
    node = lambda k, r: F.concat_ws("-", k.cast("string"), r.cast("string"))
    k, r, n = F.col("k"), F.col("r"), F.col("n")
    ahead = F.when(r < n, node(k, r + 1))
    closed = F.when((r == n) & (n > 1) & (k % 2 == 0), node(k, F.lit(1)))
    firsts = F.when((r == 1) & (k % 4 == 0), node(k + 1, r))
    return graph.cyclic(line.select(node(k, r).alias("src"), F.explode(F.array(ahead, closed, firsts)).alias("dst")))


# -- change log -------------------------------------------------------------------------------------


def changes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("sha"), seconds(F.col("ts")).alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("subject"))


@query("SELECT 'u' || user_id AS path, count(*) AS commit_count, max(epoch(ts)) AS last_modified_ts FROM events GROUP BY user_id")
def commit_freq(spark, sf):
    log = changes(spark, sf)
    return repo_files.change_stats(log, log.select("path").distinct().withColumn("mtime", F.lit(0.0)))


@query("SELECT DISTINCT 'u' || user_id AS path, 0::BIGINT AS commit_count, 5.0::DOUBLE AS last_modified_ts FROM events")
def no_history(spark, sf):
    log = changes(spark, sf)
    return repo_files.change_stats(log.limit(0), log.select("path").distinct().withColumn("mtime", F.lit(5.0)))


@query("SELECT path, round(1.0::DOUBLE / (1.0::DOUBLE + greatest((t - max(ts)) / 86400.0::DOUBLE, 0)), 9) AS recency FROM (SELECT 'u' || user_id AS path, epoch(ts) AS ts FROM events), (SELECT max(epoch(ts)) AS t FROM events) GROUP BY path, t")
def recency(spark, sf):
    log = changes(spark, sf)
    as_of = log.agg(F.max("ts").alias("t")).first()["t"]
    return log.groupBy("path").agg(F.round(rank.recency(rank.days_since(F.max("ts"), as_of)), 9).alias("recency"))


@query("""WITH x AS (SELECT CAST(event_id AS VARCHAR) AS sha, ts, event_type, 'u' || user_id AS path FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM events) - 2 * 86400),
c AS (SELECT '- `' || left(sha, 8) || '` (' || strftime(ts, '%Y-%m-%d') || ') ' || event_type AS l, row_number() OVER (ORDER BY ts DESC, sha) AS k FROM x),
p AS (SELECT DISTINCT path FROM x), t AS (SELECT path, row_number() OVER (ORDER BY path) AS k, count(*) OVER () AS n FROM p)
SELECT '### Commits' || chr(10) || chr(10) || (SELECT string_agg(l, chr(10) ORDER BY k) FROM c) || chr(10) || chr(10) || '### Files' || chr(10) || chr(10) || (SELECT string_agg('- `' || path || '`', chr(10) ORDER BY k) FROM t WHERE k <= 50)
  || (SELECT CASE WHEN count(*) > 50 THEN chr(10) || '- ... and ' || (count(*) - 50) || ' more' ELSE '' END FROM p) || chr(10) AS markdown""")
def recent_changes(spark, sf):
    log = changes(spark, sf)
    last = log.agg(F.max("ts").alias("t")).first()["t"]
    return spark.createDataFrame([(repo_files.recent_changes(log, tx.parse_since("2 days ago", last)),)], "markdown string")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(day(ts) AS INTEGER) AS n FROM events),
s AS (SELECT n || ' days ago' AS since, 1000000.0::DOUBLE - n * 86400 AS cutoff FROM d UNION ALL SELECT CAST(day AS VARCHAR), epoch(day::TIMESTAMP) FROM d
      UNION ALL SELECT day || 'T0' || n % 10 || ':00:00+03:00', epoch(day::TIMESTAMP) + (n % 10 - 3) * 3600 FROM d UNION ALL SELECT 'on ' || day, NULL FROM d)
SELECT since, cutoff FROM s""")
def since_parse(spark, sf):
    days = [r["day"] for r in table(spark, sf, "events").select(F.col("ts").cast("date").alias("day")).distinct().collect()]  # as many as the events' days
    given = [s for d in days for s in (f"{d.day} days ago", str(d), f"{d}T0{d.day % 10}:00:00+03:00", f"on {d}")]
    return spark.createDataFrame([(s, tx.parse_since(s, 1_000_000.0)) for s in given], "since string, cutoff double")


# -- files, predicates, extraction ------------------------------------------------------------------


@query(f"WITH {FILES} SELECT path, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS INTEGER) AS line_count, CAST(strlen(text) AS BIGINT) AS file_size_bytes, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM f")
def file_stats(spark, sf):
    t = F.col("text")
    return files(spark, sf).select("path", tx.line_count(t).alias("line_count"), tx.byte_size(t).alias("file_size_bytes"), tx.estimated_tokens(t).alias("tokens"))


@query(f"WITH {FILES} SELECT path, sha256(text) AS sha256, md5(text) AS md5, left(sha256(path), 16) AS short_id FROM f")
def content_hashes(spark, sf):
    return files(spark, sf).select("path", F.sha2("text", 256).alias("sha256"), F.md5(F.encode("text", "UTF-8")).alias("md5"), F.left(F.sha2("path", 256), F.lit(16)).alias("short_id"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'a' || chr(0) || text ELSE text END AS t FROM documents)
SELECT doc_id, doc_id % 5 = 0 OR (strlen(t) > 8192 AND substr(hex(encode(t)), 16385, 2) BETWEEN '80' AND 'BF') AS is_binary FROM b""")
def binary_filter(spark, sf):
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(bytearray(b"a\0")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", tx.is_binary(content).alias("is_binary"))


@query(f"WITH {VARIED} SELECT doc_id, path, folder IN ('build', 'lib/node_modules/x', '.venv/bin') OR (name IN ('app.log', '.env', 'x.lock')) OR (folder = 'docs/guide' AND name <> 'README.md') AS ignored FROM v")
def ignore_filter(spark, sf):
    rules = globs.parse_rules([*config.ALWAYS_IGNORE, "# a layer", "docs/**/*", "!docs/guide/", "!docs/**/README.md"])
    return varied(spark, sf).select("doc_id", "path", globs.ignored(F.col("path"), rules).alias("ignored"))


@query(f"WITH {VARIED} SELECT doc_id, path FROM v WHERE name NOT IN ('.env', 'id_rsa', 'key.pem', 'service-account-1.json')")
def sensitive_split(spark, sf):
    rows = varied(spark, sf)
    found = rows.where(globs.sensitive(F.col("path"), config.SENSITIVE))
    return rows.join(found.select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {VARIED} SELECT doc_id, path, name IN ('package.json', 'Makefile') OR ext IN ('.yaml', '.env') OR (ext = '.json' AND doc_id % 3 <> 0) AS is_config, folder IN ('tests', 'docs/guide') AS non_source, name = 'main.py' AS is_entry, folder NOT IN ('tests', 'docs/guide', 'build', 'pkg/config') AND ext <> '.md' AS in_diagram FROM v")
def path_predicates(spark, sf):
    p = F.col("path")
    return varied(spark, sf).select("doc_id", "path", paths.is_config(p, F.col("doc_id") % 3 == 0).alias("is_config"), paths.is_non_source(p).alias("non_source"), paths.is_entry(p).alias("is_entry"), paths.in_diagram(p).alias("in_diagram"))


@query(f"WITH {VARIED} SELECT doc_id, path, folder NOT IN ('build', 'lib/node_modules/x') AND ext IN ('.py', '.ts', '.rs', '.js') AS watched FROM v")
def watch_filter(spark, sf):
    return varied(spark, sf).select("doc_id", "path", paths.is_watched(F.col("path")).alias("watched"))


@query(f"WITH {VARIED} SELECT doc_id, name, suffix, CASE suffix WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.rs' THEN 'rust' ELSE 'unknown' END AS language, CASE WHEN suffix = '' THEN name ELSE left(name, length(name) - length(suffix)) END AS stem FROM v")
def language_map(spark, sf):
    p = F.col("path")
    return varied(spark, sf).select("doc_id", paths.name(p).alias("name"), paths.suffix(p).alias("suffix"), paths.language(p).alias("language"), paths.stem(p).alias("stem"))


@query(f"WITH {VARIED} SELECT doc_id, path, CASE WHEN path LIKE 'src/pkg/%' THEN 'src/pkg' WHEN path LIKE 'docs/%' THEN 'docs' END AS root FROM v")
def find_root(spark, sf):
    return varied(spark, sf).select("doc_id", "path", paths.longest_root(F.col("path"), F.array(*map(F.lit, ("src", "src/pkg", "docs", "doc")))).alias("root"))


def with_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with import lines of six languages before their text."""
    lang = F.element_at(F.array(*map(F.lit, ("python", "javascript", "go", "rust", "java", "ruby"))), (F.col("doc_id") % 6 + 1).cast("int"))
    head = F.concat(F.lit("import alpha.b;\n  from "), F.col("source"), F.lit(" import x\nconst y = require('z')\nuse crate::m;\nimport \"fmt\"\nimport (\"fmt\")\n\"\"\"Doc "), F.col("doc_id").cast("string"), F.lit("\"\"\"\n"))
    return table(spark, sf, "documents").select("doc_id", lang.alias("language"), F.concat(head, F.col("text")).alias("text"))


IMPORTS = """i AS (SELECT doc_id, ['python', 'javascript', 'go', 'rust', 'java', 'ruby'][doc_id % 6 + 1] AS language, 'import alpha.b;' || chr(10) || '  from ' || source || ' import x' || chr(10) || 'const y = require(''z'')' || chr(10) || 'use crate::m;' || chr(10) || 'import "fmt"' || chr(10) || 'import ("fmt")' || chr(10) || '\"\"\"Doc ' || doc_id || '\"\"\"' || chr(10) || text AS text, source FROM documents)"""


@query(f"""WITH {IMPORTS} SELECT doc_id, language, CASE language WHEN 'python' THEN 'import alpha.b;|from ' || source || ' import x|import "fmt"|import ("fmt")' WHEN 'javascript' THEN 'import alpha.b;|const y = require(''z'')|import "fmt"|import ("fmt")'
WHEN 'go' THEN 'import ("fmt")' WHEN 'rust' THEN 'use crate::m;' WHEN 'java' THEN 'import alpha.b;' ELSE '' END AS found FROM i""")
def import_extract(spark, sf):
    return with_imports(spark, sf).select("doc_id", "language", F.array_join(tx.import_lines(F.col("text"), F.col("language")), "|").alias("found"))


@query(f"WITH {FILES}, n AS (SELECT path, list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')), lambda x: x NOT IN ('def', 'class', 'import', 'from', 'return')) AS names FROM f) SELECT path, CAST(len(names) AS INTEGER) AS n_names, sha256(array_to_string(list_sort(names), ' ')) AS names_sha FROM n")
def identifier_usages(spark, sf):
    names = tx.used_names(F.col("text"))
    return files(spark, sf).select("path", F.size(names).alias("n_names"), F.sha2(F.array_join(F.array_sort(names), " "), 256).alias("names_sha"))


def named(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("path", F.posexplode(tx.used_names(F.col("text"))).alias("pos", "name"))


NAMED = f"{FILES}, nm AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM f), d AS (SELECT name, min(path) AS path FROM nm WHERE name NOT IN ('def', 'class', 'import', 'from', 'return') GROUP BY name)"


@query(f"WITH {NAMED} SELECT name, path FROM d")
def symbol_index(spark, sf):
    return report.symbol_index(named(spark, sf))


@query(f"WITH {NAMED} SELECT d.path AS defined_in, nm.path AS used_in, count(*) AS symbols, min(nm.name) AS first_symbol FROM nm JOIN d ON nm.name = d.name WHERE nm.path <> d.path GROUP BY 1, 2")
def xref_edges(spark, sf):
    names = stored(resolve.used_names(files(spark, sf)), "names")
    met = resolve.cross_references(names, names, distinct=True)
    return met.groupBy("defined_in", "used_in").agg(F.count("*").alias("symbols"), F.min("symbol").alias("first_symbol"))


@query(f"""WITH {FILES}, t AS (SELECT path, text, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 2 ELSE 3 END AS tier, (doc_id * 7 % 11)::DOUBLE AS score FROM f),
n AS (SELECT path, tier, score, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS w FROM t WHERE tier < 3),
m AS (SELECT path, tier, score, w[i] AS name, min(i) AS i FROM n, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] NOT IN ('def', 'class', 'import', 'from', 'return') GROUP BY ALL)
SELECT path, name, row_number() OVER (ORDER BY tier, score DESC, path, i) AS place FROM m QUALIFY place <= 150""")
def symbol_index_top150(spark, sf):
    ranks = files(spark, sf).select("path", F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 2).otherwise(3).alias("tier"), (F.col("doc_id") * 7 % 11).cast("double").alias("score"))
    return report.first_symbols(named(spark, sf), ranks).select("path", "name", "place")


def modules_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Python files in two roots, and an absolute and a relative import of each."""
    docs = table(spark, sf, "documents")
    n = docs.count()
    root, other = F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string")), (F.col("doc_id") * 7 + F.col("doc_id") % 3 + 2) % n
    known = docs.select(root.alias("root"), F.concat(F.col("lang"), F.lit("/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"))
    absolute, relative = F.concat(F.lit("from "), F.col("lang"), F.lit(".m"), other.cast("string"), F.lit(" import x")), F.concat(F.lit("from .m"), other.cast("string"), F.lit(" import x, y"))
    imports = docs.select(root.alias("root"), F.concat(F.col("lang"), F.lit("/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.posexplode(F.array(absolute, relative)).alias("pos", "import_text"))
    return imports, known


MODULES = """k AS (SELECT doc_id, 'r' || doc_id % 2 AS root, lang, lang || '/m' || doc_id || '.py' AS path, (doc_id * 7 + doc_id % 3 + 2) % (SELECT count(*) FROM documents) AS other FROM documents),
im AS (SELECT root, path, pos, lang || '/m' || other || '.py' AS file FROM k, (VALUES (0), (1)) AS p(pos))"""


@query(f"WITH {MODULES} SELECT im.root, im.path, im.pos, im.root AS target_root, im.file FROM im JOIN k ON im.root = k.root AND im.file = k.path")
def import_resolve(spark, sf):
    return resolve.resolve(*modules_of(spark, sf)).select("root", "path", "pos", "target_root", "file")


ROOTS = 101
#: Roots in an order that their names don't have.
ROOT_ORDER = [f"r{k}" for k in sorted(range(ROOTS), key=lambda k: k * 40 % ROOTS)]
MANY_ROOTS = f"""s AS (SELECT doc_id, 'r' || doc_id * 37 % {ROOTS} AS root, doc_id * 37 % {ROOTS} * 40 % {ROOTS} AS place, lang, lang || '/m' || doc_id % 53 || '.py' AS file, lang || '/m' || (doc_id * 7 + 3) % 59 || '.py' AS want FROM documents),
have AS (SELECT DISTINCT root, place, file FROM s),
im AS (SELECT doc_id, root, lang || '/s' || doc_id || '.py' AS path, pos, want, pos = 1 AS beside FROM s, (VALUES (0), (1)) AS p(pos)),
met AS (SELECT im.*, have.root AS target_root, row_number() OVER (PARTITION BY doc_id, pos ORDER BY CASE WHEN have.root = im.root THEN -1 ELSE place END) AS k FROM im JOIN have ON have.file = want WHERE NOT beside OR have.root = im.root)"""


@query(f"WITH {MANY_ROOTS} SELECT root, path, pos, target_root, want AS file FROM met WHERE k = 1")
def multi_root_resolve(spark, sf):
    """An absolute and a relative import of each file in 101 roots; the own root is asked first, then the others
    in their order."""
    docs = table(spark, sf, "documents")
    root, text = F.concat(F.lit("r"), (F.col("doc_id") * 37 % ROOTS).cast("string")), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    own, other = text(F.col("lang"), "/s", F.col("doc_id"), ".py"), (F.col("doc_id") * 7 + 3) % 59
    known = docs.select(root.alias("root"), F.explode(F.array(own, text(F.col("lang"), "/m", F.col("doc_id") % 53, ".py"))).alias("path"))
    both = F.array(text("from ", F.col("lang"), ".m", other, " import x"), text("from .m", other, " import x, y"))
    imports = docs.select(root.alias("root"), own.alias("path"), F.lit("python").alias("language"), F.posexplode(both).alias("pos", "import_text"))
    return resolve.resolve(imports, known, roots=ROOT_ORDER).select("root", "path", "pos", "target_root", "file")


_SCRIPT = ", ".join(f"'src/lib/u' || doc_id || '{x}'" for x in (*resolve.SCRIPT_SUFFIXES, *("/index" + y for y in resolve.SCRIPT_SUFFIXES)))


@query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN array_to_string([{_SCRIPT}], '|') WHEN 1 THEN 'src/a/b' || doc_id || '.rs|src/a/b' || doc_id || '/mod.rs'
WHEN 2 THEN 'com/x/Y' || doc_id || '.java|src/main/java/com/x/Y' || doc_id || '.java|src/com/x/Y' || doc_id || '.java' WHEN 3 THEN 'src/h/y' || doc_id || '.hpp'
WHEN 4 THEN 'src/a/c' || doc_id || '.rb|src/a/c' || doc_id ELSE 'src/p/m' || doc_id || '.py|src/p/m' || doc_id || '/__init__.py' END AS candidates FROM documents""")
def import_candidates(spark, sf):
    n = F.col("doc_id").cast("string")
    forms = {"javascript": ('import {q} from "../lib/u', '"'), "rust": ("use crate::a::b", ";"), "java": ("import com.x.Y", ";"), "cpp": ('#include "../h/y', '.hpp"'), "ruby": ('require_relative "c', '"'), "python": ("from ..p.m", " import q")}
    at = (F.col("doc_id") % 6 + 1).cast("int")
    lang = F.element_at(F.array(*map(F.lit, forms)), at)
    text = F.element_at(F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in forms.values()]), at)
    return table(spark, sf, "documents").select("doc_id", F.array_join(resolve.candidates(text, lang, F.lit("src/a/x")), "|").alias("candidates"))


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    """Generated sources, one for each document."""
    n = F.col("doc_id").cast("string")
    source = F.concat(F.lit('"""Module '), n, F.lit('."""\nimport os\nfrom .a import b\n\nLIMIT: int = '), n, F.lit('\n\n\nclass C'), n, F.lit('(Base):\n    """Doc."""\n\n    def m(self, x: int) -> str:\n        return f(x)\n\n\nasync def g(*a, k=1): ...\n'))
    return table(spark, sf, "documents").select(F.concat(F.lit("m"), n, F.lit(".py")).alias("path"), F.lit("python").alias("language"), source.alias("text"))


@query("""SELECT 'm' || doc_id || '.py' AS path, 0 AS pos, 'C' || doc_id AS name, 'class' AS kind, 'class C' || doc_id || '(Base)' AS signature, 'Doc.' AS docstring, 8 AS start_line, 12 AS end_line FROM documents
UNION ALL SELECT 'm' || doc_id || '.py', 1, 'g', 'function', 'async def g(*a, k=1)', '', 15, 15 FROM documents""")
def parse_python(spark, sf):
    return extract.symbols(extract.parse(python_files(spark, sf)))


@query("""SELECT 'm' || doc_id || '.py' AS path, 'import os|from .a import b' AS imports, 'Module ' || doc_id || '.' AS docstring, 'LIMIT: int = ' || doc_id AS constants, 'Base|C' || doc_id || '|f|int|str|x' AS usages, 'def m(self, x: int) -> str' AS methods, 16 AS line_count FROM documents""")
def python_facets(spark, sf):
    one = extract.parse(python_files(spark, sf))
    return one.select("path", F.array_join("imports", "|").alias("imports"), F.col("docstrings")[0].alias("docstring"), F.array_join("constants", "|").alias("constants"), F.array_join("usages", "|").alias("usages"), F.col("symbols")[0]["children"][0]["signature"].alias("methods"), "line_count")


@query("WITH x AS (SELECT doc_id % 7 = 0 AS failed, doc_id % 2 = 0 AS py FROM documents) SELECT CASE WHEN py THEN 'python' ELSE 'javascript' END AS language, count(*) AS total, count(*) FILTER (WHERE NOT (py AND failed)) AS success, count(*) FILTER (WHERE py AND failed) AS failed FROM x GROUP BY py")
def parse_health(spark, sf):
    text = F.when(F.col("doc_id") % 7 == 0, F.lit("def (:\n")).otherwise(F.lit("x = 1\n"))
    lang = F.when(F.col("doc_id") % 2 == 0, F.lit("python")).otherwise(F.lit("javascript"))
    return extract.health(extract.parse(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), lang.alias("language"), text.alias("text"))))


# -- reports ----------------------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT language, count(*) AS files FROM f GROUP BY language")
def lang_histogram(spark, sf):
    return files(spark, sf).groupBy("language").agg(F.count("*").alias("files"))


@query(f"WITH {FILES} SELECT split_part(path, '/', 1) AS folder, count(*) AS files FROM f GROUP BY 1 ORDER BY files DESC, folder LIMIT 5")
def top_dirs(spark, sf):
    return report.top_folders(files(spark, sf))


@query("WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(n || ' ' || event_type || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY event_type) AS kinds FROM k GROUP BY user_id")
def kind_summary(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(render.kind_counts(F.collect_list("event_type")).alias("kinds"))


@query(f"WITH {IMPORTS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id ELSE '2 imports, ' || (length(text) - length(replace(text, chr(10), '')) + 1) || ' lines' END AS line FROM i")
def one_liner(spark, sf):
    doc = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit("\nmore")))).otherwise(F.array().cast("array<string>"))
    none = F.from_json(F.lit("[]"), "array<struct<name: string, kind: string>>")
    return with_imports(spark, sf).select("doc_id", render.one_liner(doc, none, F.array(F.lit("a"), F.lit("b")), tx.line_count(F.col("text"))).alias("line"))


@query("""WITH s AS (SELECT doc_id, 'def f' || doc_id || '(' || array_to_string(list_transform(range(0, doc_id % 30), lambda i: 'arg' || i || '=None'), ', ') || ')' AS sig, 'def f' || doc_id || '(' AS head, list_transform(range(0, doc_id % 30), lambda i: 'arg' || i || '=None') AS a FROM documents),
c AS (SELECT doc_id, sig, head, a, list_max(list_filter(range(0, len(a) + 1), lambda n: length(head || array_to_string(a[1:n], ', ')) + 5 <= 120 OR n = 0)) AS n FROM s)
SELECT doc_id, CASE WHEN length(sig) <= 120 THEN sig WHEN n = 0 THEN head || '...)' ELSE head || array_to_string(a[1:n], ', ') || CASE WHEN n < len(a) THEN ', ...' ELSE '' END || ')' END AS signature FROM c""")
def signature_truncate(spark, sf):
    args = F.transform(F.sequence(F.lit(0), F.greatest(F.col("doc_id") % 30 - 1, F.lit(0))), lambda i: F.concat(F.lit("arg"), i.cast("string"), F.lit("=None")))
    sig = F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("("), F.when(F.col("doc_id") % 30 > 0, F.array_join(args, ", ")).otherwise(""), F.lit(")"))
    return table(spark, sf, "documents").select("doc_id", tx.short_signature(sig).alias("signature"))


@query("SELECT doc_id, left('Para of ' || source || ' and ' || lang, 200) AS excerpt, 'Para of ' || source AS summary FROM documents")
def arch_excerpt(spark, sf):
    text = F.concat(F.lit("\n# Head\n\nPara of "), F.col("source"), F.lit("\n  and "), F.col("lang"), F.lit("\n\nSecond.\n"))
    return table(spark, sf, "documents").select("doc_id", tx.excerpt(text).alias("excerpt"), tx.summary_line(F.replace(F.replace(text, F.lit("# Head"), F.lit("### `x`\n```py")), F.lit("\n  and"), F.lit("  \n"))).alias("summary"))


@query(f"""WITH {FILES}, n AS (SELECT path, doc_id, length(text) - length(replace(text, chr(10), '')) + 1 + doc_id % 9 AS n, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x, ' ' || chr(9)), '@'))) + doc_id % 9 AS ats FROM f)
SELECT path, concat_ws('; ', CASE WHEN doc_id % 7 = 0 THEN 'partial parse' END, CASE WHEN doc_id % 5 > 2 THEN 'async-heavy (' || doc_id % 5 || ' async functions)' END, CASE WHEN ats > 5 THEN 'decorator-heavy (' || ats || ' decorators)' END, CASE WHEN n > 300 THEN 'large file (' || n || ' lines)' END) AS notes FROM n""")
def notes(spark, sf):
    own = F.from_json(F.lit('[{"signature": "async def f()"}, {"signature": "def s()"}]'), "array<struct<signature: string>>")
    # methods of a class count too
    children = F.array_repeat(own[0], F.greatest(F.col("doc_id") % 5 - 1, F.lit(0)).cast("int"))
    first = F.when(F.col("doc_id") % 5 > 0, own[0]["signature"]).otherwise(own[1]["signature"])
    symbols = F.array(F.struct(first.alias("signature"), children.alias("children")))
    text = F.concat(F.repeat(F.lit(" @d\n"), (F.col("doc_id") % 9).cast("int")), F.col("text"))
    return files(spark, sf).select("path", F.array_join(render.notes(F.col("doc_id") % 7 == 0, symbols, text, tx.line_count(text)), "; ").alias("notes"))


# -- embeddings -------------------------------------------------------------------------------------


@query(f"WITH {REL} SELECT vec_id, label, relevance FROM rel")
def semantic_scores(spark, sf):
    return relevances(spark, sf).select("vec_id", "label", "relevance")


@query(f"WITH {REL} SELECT vec_id, relevance FROM rel ORDER BY relevance DESC, vec_id LIMIT 10")
def semantic_topk(spark, sf):
    return semantic.top(relevances(spark, sf), 10, "vec_id").select("vec_id", "relevance")


@query(f"WITH {REL} SELECT vec_id, label, relevance FROM rel ORDER BY relevance DESC, vec_id LIMIT 10")
def semantic_index_topk(spark, sf):
    """The search by cells."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return vectors.build(rows).search(rows.where("vec_id = 0").first()["embedding"], 10, "vec_id").select("vec_id", "label", "relevance")


@query("SELECT CAST(len(embedding) AS INTEGER) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def embedding_dims(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))


# -- what is kept -----------------------------------------------------------------------------------


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) files by hash: some changed, some gone, some added."""
    docs = files(spark, sf)
    old = docs.where("doc_id % 11 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    new = docs.where("doc_id % 13 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return old, new


@query(f"WITH {FILES} SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 13 = 0 THEN 'removed' ELSE 'changed' END AS change FROM f WHERE (doc_id % 11 = 0) <> (doc_id % 13 = 0) OR (doc_id % 5 = 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0)")
def manifest_diff(spark, sf):
    return cache.differences(*versions(spark, sf))


@query(f"WITH {FILES} SELECT path FROM f WHERE doc_id % 13 <> 0 AND (doc_id % 11 = 0 OR doc_id % 5 = 0)")
def cache_miss_antijoin(spark, sf):
    old, new = versions(spark, sf)
    return cache.split_by_cache(new, old)[1].select("path")


@query(f"WITH {FILES} SELECT path, sha256(CASE WHEN doc_id % 13 <> 0 AND doc_id % 5 = 0 THEN text || '!' ELSE text END) AS sha256 FROM f WHERE doc_id % 11 <> 0 OR doc_id % 13 <> 0")
def cache_upsert(spark, sf):
    old, new = versions(spark, sf)
    return cache.upserted(old, new, "path")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0")
def evict_stale(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "label")
    return cache.evicted(vectors, vectors.where("vec_id % 3 = 0").select("vec_id"), "vec_id")


# -- streams ----------------------------------------------------------------------------------------

SESSIONS = """WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT event_type, min(ts) AS start, count(*) AS events, array_to_string(list_sort(list(DISTINCT 'u' || user_id)), ',') AS paths FROM y GROUP BY event_type, s"""


@query(SESSIONS)
def debounce_sessions(spark, sf):
    events = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_path"), F.lit(False).alias("is_directory"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return debounce.batches(events, 600, key="event_type").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events", F.array_join("paths", ",").alias("paths"))


from . import run_queries  # noqa: E402, F401  more queries, of runs and what they keep
