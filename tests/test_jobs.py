"""The jobs: a stream over a growing folder, reruns, a crash within a step, odd rows."""

import logging
import shutil

import pytest
from pyspark.sql import functions as F

from jobs import common, context_digest, document_index, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def add(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def index(spark, at):
    rows = document_index.run(spark, str(at / "docs"), str(at / "index"), str(at / "mark"))
    return {r["path"]: (r["change"], r["step"], r["tokens"], r["names"]) for r in rows.collect()}


def test_an_index_takes_only_what_is_new(spark, tmp_path, caplog):
    add(spark, tmp_path / "docs", [(1, "one two\nthree", "en", "a", 1), (2, None, "", None, 0), (None, "no id", None, "b", 5)])
    first = index(spark, tmp_path)
    assert first["a/en/1.txt"] == ("added", 0, 4, ["one", "three", "two"])
    assert len(first) == 3 and all(v[:2] == ("added", 0) for v in first.values())
    with caplog.at_level(logging.INFO):
        assert index(spark, tmp_path) == first
    assert "0 rows read" in caplog.text
    # a new document, a new version, and one that another file brings again
    add(spark, tmp_path / "docs", [(3, "three", "en", "a", 5), (1, "one", "en", "a", 3), (2, "", "", None, 0)])
    with caplog.at_level(logging.INFO):
        second = index(spark, tmp_path)
    assert "3 rows read" in caplog.text and "2 versions written" in caplog.text
    assert second["a/en/1.txt"] == ("changed", 1, 1, ["one"]) and second["a/en/3.txt"][:2] == ("added", 1)
    assert {k: v for k, v in second.items() if v[1] == 0} == {k: v for k, v in first.items() if k != "a/en/1.txt"}
    assert sorted(p.name for p in (tmp_path / "index" / "step=0").iterdir() if p.is_dir()) == ["language=en", "language=und"]


def test_a_step_that_a_crash_cut_short_is_taken_again(spark, tmp_path):
    add(spark, tmp_path / "docs", [(1, "one", "en", "a", 3)])
    index(spark, tmp_path)
    add(spark, tmp_path / "docs", [(1, "uno", "en", "a", 3), (2, "two", "en", "a", 3)])
    done = index(spark, tmp_path)
    # as if the driver had died after the write and before the mark
    for p in (tmp_path / "mark" / "commits").glob("*1*"):
        p.unlink()
    assert index(spark, tmp_path) == done
    assert document_index.kept(spark, str(tmp_path / "index")).count() == 3


def test_files_are_taken_in_steps(spark, tmp_path):
    for i in range(5):
        add(spark, tmp_path / "docs", [(i, f"text {i}", "en", "a", 6)])
    rows = document_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "index"), str(tmp_path / "mark"), files_at_once=2)
    assert sorted(r["step"] for r in rows.select("step").collect()) == [0, 0, 1, 1, 2]


def test_a_digest_keeps_to_its_budget_and_can_be_made_again(spark, tmp_path):
    text = lambda i: "\n".join(f"alpha{i} beta{j} shared words of many letters" for j in range(12))
    rows = [(i, text(i), "en", f"s{i % 3}", 0) for i in range(40)] + [(7, "again", "en", "s1", 0), (50, None, None, None, 0), (None, "odd", "en", "", 0)]
    add(spark, tmp_path / "docs", rows)
    log = [(i % 9, f"2024-01-0{1 + i % 9} 00:00:00") for i in range(60)] + [(None, "2024-01-01 00:00:00"), (3, None)]
    spark.createDataFrame(log, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "log"))
    make = lambda **o: sorted(map(tuple, context_digest.run(spark, str(tmp_path / "docs"), str(tmp_path / "log"), str(tmp_path / "out"), **o).collect()), key=str)
    some = make(budget=500)
    assert sum(r[4] for r in some) == 500 and any(r[4] < r[3] for r in some)
    cut = next(r for r in some if r[4] < r[3])
    assert cut[5].startswith("alpha") and cut[5].endswith("[truncated to fit token budget]")
    debug = make(budget=500, task="debug")
    assert make(budget=500) == some and debug != some
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["task=debug", "task=default"]
    whole = make(budget=10**6)
    assert len(whole) == 42 and all(r[3] == r[4] for r in whole)
    assert {r[6] for r in whole} == {"s0", "s1", "s2", "none"}
    shutil.rmtree(tmp_path / "log")
    spark.createDataFrame([], "user_id long, ts timestamp").write.parquet(str(tmp_path / "log"))
    assert len(make(budget=10**6)) == 42


def test_no_documents(spark, tmp_path):
    add(spark, tmp_path / "docs", [])
    spark.createDataFrame([], "user_id long, ts timestamp").write.parquet(str(tmp_path / "log"))
    assert index(spark, tmp_path) == {}
    assert context_digest.run(spark, str(tmp_path / "docs"), str(tmp_path / "log"), str(tmp_path / "out")).count() == 0


def test_settings_come_from_the_file_and_the_command_line(tmp_path):
    given = common.settings("", document_index.CONFIG, ["--documents", "d", "--out", "o", "--checkpoint", "c"])
    assert given == {"documents": "d", "out": "o", "checkpoint": "c", "files_at_once": 1000}
    with pytest.raises(SystemExit):
        common.settings("", document_index.CONFIG, ["--documents", "d"])
    own = tmp_path / "own.toml"
    own.write_text('documents = "x"\nchanges = "y"\nout = "z"\nbudget = 5\n')
    assert common.settings("", context_digest.CONFIG, ["--config", str(own), "--budget", "6"]) == {"documents": "x", "changes": "y", "out": "z", "budget": 6}


def test_queries_leave_their_files_and_names_apart(spark):
    a, b = (queries.job1_document_index(spark, SF) for _ in range(2))
    assert a.inputFiles() != b.inputFiles()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert set(queries.QUERIES) == set(queries.SQL)
