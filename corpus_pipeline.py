"""Documents to training sequences: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``. What a stage
decides takes effect at once, and later stages work on all that it kept.

SQL can't express the fingerprints of near-dedup nor the ids of packing, so there is no ORACLE_SQL;
tests/llm/test_corpus_operators.py holds ``run`` against a brute-force version.

Defined cases: rows with a null text go at the first stage, and so do empty ones; null doc_ids, lang,
source and other columns pass through; repeated rows are judged each, so that of equal texts of one
doc_id all stay or go together, but for their lines, which the first keeps; names of further columns
never clash with what the stages add meanwhile; an empty table stays empty, an empty benchmark takes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, line_dedup, packing, phrase_index, simhash_golay
from corpusloom.llm.common import free_name, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages; texts without a letter, null texts and texts in which no language
    has ``langid.LEAST`` of the letters go."""
    return langid.accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has, or nearly has. A document of which
    only blank lines are left goes; one that had no others stays as it is."""
    same, near = free_name(docs.columns, "_same"), free_name(docs.columns, "_near")
    done = line_dedup.clean(docs, (same, near))
    empty = (F.col(same) + F.col(near) > 0) & ~F.col("text").rlike(r"[^ \t\r\f\n]")
    return done.where(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group; rows of one doc_id are one document, and a
    row without a doc_id stays."""
    classes = simhash_golay.near_duplicates(docs)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows are judged each by its own text: another row
    of the same doc_id, or without one, stays if it is clean."""
    judged = phrase_index.contamination(phrase_index.build(docs), table(spark, sf_dir, "benchmark"), text_key=True)
    gone = judged.where("contaminated").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a row of each piece, so columns are its own."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage_{name}")
    return docs
