"""What both jobs' command lines share: settings, a session, a log."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settings(doc: str, default: Path, argv: list[str] | None = None) -> dict:
    """The settings file's values, each of which an option of the same name replaces."""
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default=str(default))
    path, rest = first.parse_known_args(argv)
    found = tomllib.loads(Path(path.config).read_text(encoding="utf-8"))
    options = argparse.ArgumentParser(description=doc, parents=[first])
    for name, value in found.items():
        options.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    given = vars(options.parse_args(rest))
    given.pop("config")
    if missing := [k for k, v in given.items() if v == ""]:
        options.error("not given: " + ", ".join(f"--{k.replace('_', '-')}" for k in missing))
    return given


def main(name: str, doc: str, default: Path, run: Callable[..., object], argv: list[str] | None = None) -> None:
    """``run`` with the settings, in a session that begins and ends here."""
    given = settings(doc, default, argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **given)
    finally:
        spark.stop()


def path_of(source: Column, lang: Column, doc_id: Column, sha256: Column) -> Column:
    """A document's path: source and language as folders, its id, or without one its hash, as the name."""
    name = F.coalesce(doc_id.cast("string"), F.left(sha256, F.lit(16)))
    return F.concat_ws("/", source, lang, F.concat(name, F.lit(".txt")))


def documents(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, path, source, lang, sha256, text) of a table of documents; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text")).withColumn("sha256", F.sha2("text", 256))
    return own.select("doc_id", path_of(F.col("source"), F.col("lang"), F.col("doc_id"), F.col("sha256")).alias("path"), "source", "lang", "sha256", "text")
