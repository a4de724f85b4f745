"""Queries of the operators here, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, line_dedup, merkle, packing, phrase_index, pii, simhash_golay, suffix_dedup, tiff, token_store, url_filter
from .common import table


#: Of the query alone; a real run names its own.
PII_KEY = b"corpusloom example key"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op3_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(phrase_index.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(tiff.read(tiff.store(table(spark, sf_dir, "documents"))))


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PII_KEY)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    return line_dedup.clean(docs, ("n_exact", "n_near")).select("doc_id", "n_lines", "n_exact", "n_near", "text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_langid, op3_phrase_index, op4_tiff, op5_simhash_golay, op6_pii, op7_line_dedup, op8_url_filter, op9_best_fit_packing, op10_token_store, op11_merkle_manifest, op12_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_phrase_index": phrase_index.ORACLE_SQL, "op7_line_dedup": line_dedup.ORACLE_SQL, "op8_url_filter": url_filter.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_suffix_dedup": suffix_dedup.ORACLE_SQL}
