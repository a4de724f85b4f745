"""The jobs as queries over the test tables, with the same rows in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.storage import shared_dir
from jobs import context_digest, document_index

#: Tokens of the digest that the query makes.
BUDGET = 60_000


def job1_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same folder and checkpoint: the second has nothing new to take."""
    at = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        rows = document_index.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    return rows.select("doc_id", "path", "source", "lang", "sha256", "change", "n_lines", "n_bytes", "tokens", "first_line", F.size("names").alias("n_names"), F.sha2(F.array_join("names", " "), 256).alias("names_sha256"))


def job2_context_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        rows = context_digest.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/events.parquet", f"{at}/digest", budget=BUDGET)
    return rows.select("path", "source", "tier", "score", "tokens", "charged", F.sha2("content", 256).alias("content_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_document_index, job2_context_digest)}

_DOCS = """d0 AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS sha256 FROM documents),
d AS (SELECT *, concat_ws('/', source, lang, coalesce(CAST(doc_id AS VARCHAR), left(sha256, 16)) || '.txt') AS path FROM d0 QUALIFY row_number() OVER (PARTITION BY source, lang, coalesce(CAST(doc_id AS VARCHAR), sha256) ORDER BY sha256 DESC) = 1)"""
_NAMES = "list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')), lambda x: x NOT IN ('def', 'class', 'import', 'from', 'return'))"
_WEIGHTS = config.weights("default")
_USED = [s for s in config.SIGNALS if _WEIGHTS[s]]
_SCALED = ", ".join(f"CASE WHEN max({s}) OVER () > min({s}) OVER () THEN ({s} - min({s}) OVER ()) / (max({s}) OVER () - min({s}) OVER ()) ELSE 0.0::DOUBLE END AS {s}" for s in _USED)
_TOTAL = " + ".join(f"{_WEIGHTS[s]!r}::DOUBLE * {s}" for s in _USED)

SQL = {
    "job1_document_index": f"""WITH {_DOCS}, n AS (SELECT *, list_sort({_NAMES}) AS names FROM d)
SELECT doc_id, path, source, lang, sha256, 'added' AS change, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS INTEGER) AS n_lines,
       CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, split_part(text, chr(10), 1) AS first_line, CAST(len(names) AS INTEGER) AS n_names, sha256(array_to_string(names, ' ')) AS names_sha256
FROM n""",
    "job2_context_digest": f"""WITH RECURSIVE {_DOCS}, nm AS (SELECT path, unnest({_NAMES}) AS name FROM d),
first AS (SELECT name, min(path) AS path FROM nm GROUP BY name),
met AS (SELECT first.path AS path, count(DISTINCT nm.path)::DOUBLE AS fan_in FROM nm JOIN first ON nm.name = first.name WHERE nm.path <> first.path GROUP BY first.path),
log AS (SELECT user_id AS doc_id, count(*)::DOUBLE AS freq, max(epoch(ts)) AS last_ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id),
sig AS (SELECT d.path, d.source, d.text, coalesce(freq, 0.0::DOUBLE) AS freq, coalesce(fan_in, 0.0::DOUBLE) AS fan_in, 0.0::DOUBLE AS proximity,
               1.0::DOUBLE / (1.0::DOUBLE + coalesce(greatest(((SELECT max(last_ts) FROM log) - last_ts) / 86400.0::DOUBLE, 0.0::DOUBLE), 365.0::DOUBLE)) AS recency
        FROM d LEFT JOIN log ON d.doc_id = log.doc_id LEFT JOIN met ON d.path = met.path),
norm AS (SELECT path, source, text, {_SCALED} FROM sig),
scored AS (SELECT path, source, text, round(least(greatest({_TOTAL}, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS score FROM norm),
lim AS (SELECT list(score ORDER BY score DESC) AS s FROM scored),
tiered AS (SELECT path, source, text, score, CAST(CASE WHEN score >= s[greatest(1, floor(len(s) * 0.15::DOUBLE))::INT] THEN 1 WHEN score >= s[least(greatest(2, floor(len(s) * 0.45::DOUBLE)), len(s))::INT] THEN 2 ELSE 3 END AS INTEGER) AS tier FROM scored, lim),
shown AS (SELECT path, source, tier, score, CASE tier WHEN 1 THEN text WHEN 2 THEN left(text, {context_digest.BEGINNING}) ELSE left(split_part(text, chr(10), 1), {context_digest.LINE}) END AS content FROM tiered),
c AS (SELECT *, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM shown),
b AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY tier, score DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE tier < 3),
lft AS (SELECT {BUDGET} - coalesce(sum(least(tokens, {BUDGET} - before)), 0) AS r FROM b WHERE before < {BUDGET}),
o AS (SELECT path, tokens, row_number() OVER (ORDER BY score DESC, path) AS k FROM c WHERE tier = 3 AND (SELECT r FROM lft) > 0),
g AS (SELECT 0::BIGINT AS k, r::BIGINT AS r, NULL::VARCHAR AS path, false AS taken FROM lft
      UNION ALL SELECT o.k, CASE WHEN o.tokens <= g.r AND g.r > 0 THEN g.r - o.tokens ELSE g.r END, o.path, o.tokens <= g.r AND g.r > 0 FROM g JOIN o ON o.k = g.k + 1),
taken AS (SELECT path, source, tier, score, tokens, CAST(least(tokens, {BUDGET} - before) AS BIGINT) AS charged, content FROM b WHERE before < {BUDGET}
      UNION ALL SELECT c.path, source, tier, score, tokens, tokens, content FROM c JOIN g ON c.path = g.path WHERE taken)
SELECT path, CASE WHEN coalesce(source, '') = '' THEN 'none' ELSE source END AS source, tier, score, tokens, charged,
       sha256(CASE WHEN charged < tokens THEN left(content, charged * 4) || chr(10) || '... [truncated to fit token budget]' ELSE content END) AS content_sha256
FROM taken""",
}
