"""URL filters whose decisions reach the aliases of an address.

A rule (host, path, verdict) fits its host and all subdomains where the address's path starts with
the rule's; the longest rule wins. Rules are found by equal keys: an address asks for each suffix
of its host with each path prefix of a length that rules have, so any number of rules needs one
join and no address meets a rule that doesn't fit.

Aliases: a page's redirect (``meta http-equiv=refresh``) and canonical link (``link
rel=canonical``), and any further edges given, join addresses into classes by distributed connected
components. An address without a rule takes its class's decision: allow if a rule allows any of
its members, else block if a rule blocks any, else allow.

Defined cases: a null address or one without ``://`` has empty host and path and no alias; a page's
alias to itself says nothing; an alias that is no page counts with its own rules; repeated rows are
judged alike; two rules with the same host and path: allow wins; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: The query's rules: host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Rules that are broadcast; more of them are joined by a shuffle.
BROADCAST_RULES = 100_000

_TAG = re.compile(r"<(link|meta)\b([^>]*)>", re.I)
_ATTRIBUTE = re.compile(r"([a-z\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_REFRESH = re.compile(r"^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]+)", re.I)


def host(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """An address as a node: host in small letters, no fragment; null if it is none."""
    whole = F.regexp_extract(url, r"^((?s:.*?)://)[^/?#]*([^#]*)", 1)
    rest = F.regexp_extract(url, r"^((?s:.*?)://)[^/?#]*([^#]*)", 2)
    return F.when(url.contains("://"), F.concat(F.lower(whole), host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def targets(page: str, url: str) -> list[str]:
    """Where a page says it lives: its redirect and its canonical link."""
    out = []
    for name, attributes in _TAG.findall(page):
        at = {k.lower(): html.unescape("".join(v)) for k, *v in _ATTRIBUTE.findall(attributes)}
        to = None
        if name.lower() == "link" and "canonical" in at.get("rel", "").lower().split():
            to = at.get("href")
        elif name.lower() == "meta" and at.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(at.get("content", ""))):
            to = m[1]
        if to and to.strip():
            try:
                out.append(urljoin(url, to.strip()))
            except ValueError:
                continue
    return out


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes from ``pages`` (url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, t) for u, h in zip(b.column(0).to_pylist(), b.column(1), strict=True) for t in targets(h.as_py(), u)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], ["u", "t"])

    some = pages.where("url is not null and html is not null").select("url", "html").where(F.col("url").contains("://"))
    edges = common.mapped(some, run, "u string, t string").select(node(F.col("u")).alias("a"), node(F.col("t")).alias("b"))
    return edges.where("a <> b")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, path, rule, verdict) for the distinct (host, path) of ``urls`` that a rule fits."""
    lengths = [r["n"] for r in rules.select(F.length("rule_path").alias("n")).distinct().collect()]  # at most as many as paths have letters
    if not lengths:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    keys = rules.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
    if keys.count() <= BROADCAST_RULES:
        keys = F.broadcast(keys)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.where("host <> ''").select("host", "path").distinct()
    asked = asked.withColumn("rule_host", F.explode(suffixes)).withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where(F.length("path") >= F.col("n"))
    met = asked.withColumn("rule_path", F.expr("substring(path, 1, n)")).join(keys, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "verdict")).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) of ``pages`` (page_id, url, html). ``edges``: further
    aliases (a, b), as addresses."""
    alias = alias_edges(pages)
    if edges is not None:
        alias = alias.unionAll(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")).where("a <> b"))
    classes = common.stored(components(alias), "alias_classes")
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    nodes = classes.select(host(F.col("node")).alias("host"), path(F.col("node")).alias("path"))
    verdicts = common.stored(ruled(urls.select("host", "path").unionAll(nodes), rules), "ruled_urls")
    members = classes.withColumns({"host": host(F.col("node")), "path": path(F.col("node"))}).join(verdicts, ["host", "path"])
    decided = members.groupBy("component").agg(F.min("verdict").alias("of_class"))  # allow comes before block
    by_node = classes.join(decided, "component").select("node", "of_class")
    # both grow with the pages, however well they compress: neither is to be broadcast
    out = urls.join(verdicts.hint("merge"), ["host", "path"], "left").join(by_node.hint("merge"), "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "of_class", F.lit("allow")).alias("verdict"))


#: The same result in DuckDB, with the query's rules, where pages name their aliases by whole addresses:
#: classes are the closure of all links.
ORACLE_SQL = r"""
WITH RECURSIVE r(rule_host, rule_path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
tag AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS t FROM pages WHERE contains(url, '://')),
alias AS (SELECT url, CASE WHEN regexp_matches(t, '(?i)^<link') AND regexp_matches(t, '(?i)\srel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(t, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
                 WHEN regexp_matches(t, '(?i)^<meta') AND regexp_matches(t, '(?i)http-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?i)[;,\s"'']url\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END AS target FROM tag),
u0(page_id, url) AS (SELECT page_id, coalesce(url, '') FROM pages UNION ALL SELECT NULL, target FROM alias WHERE contains(target, '://')),
u AS (SELECT *, lower(regexp_extract(url, '^((?s:.*?)://)', 1)) || host || CASE WHEN rest = '' THEN '/' ELSE rest END AS node
      FROM (SELECT page_id, url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS rest FROM u0)),
e AS (SELECT DISTINCT x.node AS a, y.node AS b FROM alias JOIN u x ON x.url = alias.url JOIN u y ON y.url = alias.target WHERE contains(alias.target, '://')),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
m AS (SELECT url, rule_host || rule_path AS rule, verdict FROM (SELECT DISTINCT url, host, path FROM u) JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule_host || rule_path) DESC) = 1),
c AS (SELECT reach.a AS node, min(m.verdict) AS of_class FROM reach JOIN u ON u.node = reach.b JOIN m ON m.url = u.url GROUP BY reach.a)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, c.of_class, 'allow') AS verdict FROM u LEFT JOIN m ON u.url = m.url LEFT JOIN c ON u.node = c.node WHERE page_id IS NOT NULL
"""
