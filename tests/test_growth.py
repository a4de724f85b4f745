"""What larger tables showed: results at limits that small tables don't reach, and what is shuffled and kept."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, resolve
from corpusloom.plans import providers, queries, run_queries
from corpusloom.streaming import debounce

DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string"


def documents(spark, folder, rows):
    """A table of documents (doc_id, source, lang, text)."""
    spark.createDataFrame([(i, s, la, len(t), t) for i, s, la, t in rows], DOCUMENT).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_notes_count_the_lines_of_the_same_text(spark, tmp_path):
    """Eight lines go before the text of document 8: 301 lines and 300, where a file is large from 301 on."""
    sf = documents(spark, tmp_path, [(8, "a", "en", "x\n" * 292), (17, "a", "en", "x\n" * 291)])
    assert {r.path: r.notes for r in queries.notes(spark, sf).collect()} == {"a/en/8.txt": "async-heavy (3 async functions); decorator-heavy (8 decorators); large file (301 lines)", "a/en/17.txt": "decorator-heavy (8 decorators)"}


def test_a_streams_events_reach_its_state_as_batches(spark, tmp_path):
    """2000 events of one tree at 500 places: what is kept and looked at are the batches that are open."""
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [{"src_path": f"src/{i % 500}.py", "is_directory": False, "ts": (at + datetime.timedelta(seconds=i / 2)).isoformat()} for i in range(2000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    run = debounce.write_batches(debounce.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination(120)
    assert max(op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]) <= 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("most", [1, 3, 100])
def test_cross_references_of_frequent_and_other_names(spark, monkeypatch, most):
    """Rows are the same whether all names, some or hardly any go to every task; a path that comes twice counts once."""
    monkeypatch.setattr(resolve, "BROADCAST", most)
    texts = [("b", "x y z own_b"), ("a", "x w"), ("c", "x y w z"), ("c", "x y q"), ("d", "w x return"), (None, "x y"), ("e", None)]
    names = resolve.used_names(spark.createDataFrame(texts, "path string, text string"))
    rows = [(r.path, r.name) for r in names.collect()]
    want = {(p, n) for p, t in texts for n in (t or "").split() if n != "return"}
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    first = {n: min(p for p, m in want if m == n and p) for _, n in want}
    got = resolve.cross_references(names, names, distinct=True)
    assert sorted(map(tuple, got.collect())) == sorted((n, first[n], p) for p, n in want if p and p != first[n])


@pytest.mark.parametrize("most", [2, 5, 200_000])
def test_cycles_by_ranges_of_names(spark, monkeypatch, most):
    """Ranges of any size find the same nodes, whatever is left for the driver or the colors."""
    monkeypatch.setattr(graph, "EDGES", most)
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "_by_colors", lambda left, n, by=graph._by_colors: left.select("src").distinct().count() < 60 and by(left, n))
    rings = [(f"{k}-{r}", f"{k}-{r % 3 + 1}") for k in range(0, 60, 2) for r in (1, 2, 3)]
    chains = [(f"{k}-{r}", f"{k}-{r + 1}") for k in range(1, 60, 2) for r in (1, 2)] + [(f"{k}-1", f"{k + 1}-1") for k in range(0, 60, 4)]
    across = [("a", "z"), ("z", "a"), ("a", "m"), ("m", "n"), ("c", "c"), *(("hub", f"h{i}") for i in range(9)), ("h3", "hub")]
    e = spark.createDataFrame((rings + chains + across) * 2, "src string, dst string")
    got = sorted(r.path for r in graph.cyclic(e).collect())
    assert got == sorted({a for a, _ in rings} | {"a", "z", "hub", "h3"})


def test_a_range_leaves_no_edges_that_end_in_it(spark):
    e = spark.createDataFrame([(f"{k:03}-{r}", f"{k:03}-{r % 4 + 1}") for k in range(50) for r in (1, 2, 3, 4)], "src string, dst string")
    assert [(r.dst is None, r.n) for r in graph._ranges(e).groupBy("dst").agg({"*": "count"}).toDF("dst", "n").collect()] == [(True, 200)]


ODD = ["a", "", "  \t\n \t ", None, "\n\n  x y \t\nz", "\r\nfirst\r\nsecond", "a\r\nb", "\xa0\nb", "\u3000x\u3000\nb", "a\u2028b\nc", "a\x0bb", "\x0c\nq", "a\x1cb", "\x85\nz", " " * 5 + "x" * 130, "x" * 119 + "   y", "é\n", "\0", "\U0001f468\u200d" * 90]


def test_fallback_summaries_are_those_of_the_sql(spark, tmp_path):
    """Texts without a line, without anything, and with signs that end a line or are blank elsewhere."""
    import duckdb

    spark.createDataFrame([(i, "a", "en", 0, t) for i, t in enumerate(ODD)], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.SQL["fallback_summaries"]).fetchall()
    assert sorted(map(tuple, run_queries.fallback_summaries(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    # whole runs keep to the reference: every sign that ends a line, every blank, and a note on empty files
    assert [providers.first_line("p", t) for t in ("\r\n a\r\nb", " \n", None)] == ["p: a", "p: empty file", "p: empty file"]


@pytest.mark.parametrize("most", [1, 3, 2048])
def test_go_folders_by_blocks(spark, monkeypatch, most):
    """Blocks, runs and tasks of any size pair the same imports and files, in an import's own root and in another."""
    for name, n in {"BLOCK": most, "RUN": most, "PAIRS": 50 * most, "BROADCAST": most}.items():
        monkeypatch.setattr(resolve, name, n)
    files = [(r, f"{d}/f{i}.go") for r, d, n in (("a", "x", 5), ("a", "x/y", 4), ("b", "z", 7), ("b", "x", 2)) for i in range(n)]
    files += [("a", ".go"), ("a", "x.go"), ("a", "x/f0.py"), ("b", "top.go")]
    modules = {("a", ""): "ex.com", ("b", ""): "ex.com/b", ("a", "x/y"): "own.org/y"}
    packages = ["ex.com", "ex.com/x", "ex.com/x/", "ex.com/x/y", "ex.com/z", "ex.com/b", "ex.com/b/x", "own.org/y/x", "own.org/y", "x/y", "ex.com/top", "ex.com/none", "fmt", "a/b"]
    imports = [(r, p, "go", i, f'"{g}"') for r, p in files if p.endswith(".go") for i, g in enumerate(packages)]

    def above(path):
        parts = path.split("/")[:-1]
        return ["/".join(parts[:i]) for i in range(len(parts) + 1)]

    def meant(r, p, text, root):
        pkg, module = text.strip('"'), next((modules[r, d] for d in reversed(above(p)) if (r, d) in modules), None)
        want = "" if pkg == module else pkg[len(module) + 1 :] if pkg.startswith(f"{module}/") else pkg
        return [(root, f) for q, f in files if q == root and f.endswith(".go") and "/" in pkg and (want.strip("/") in above(f) or want.strip("/") == f[:-3])]

    known = spark.createDataFrame(files * 2, "root string, path string")
    named = spark.createDataFrame([(*k, m) for k, m in modules.items()], "root string, dir string, module string")
    rows = spark.createDataFrame(imports, "root string, path string, language string, pos int, import_text string")
    for roots in (None, ["b", "a"]):
        found = [(i, next(filter(None, (meant(i[0], i[1], i[4], x) for x in [i[0], *(roots or ())])), [])) for i in imports]
        want = [(r, p, pos, t, *m) for (r, p, _, pos, t), ms in found for m in ms]
        assert sorted(map(tuple, resolve.resolve(rows, known, named, roots).collect())) == sorted(want)


def test_pairs_of_one_folder_go_to_many_tasks_and_take_little_space(spark, tmp_path, monkeypatch):
    """Half a million pairs of one folder's imports and files, from a few kilobytes."""
    for name, most in {"BLOCK": 256, "RUN": 128, "PAIRS": 50_000}.items():
        monkeypatch.setattr(resolve, name, most, raising=False)
    known = spark.range(1000).select(F.lit("r").alias("root"), F.concat(F.lit("p/f"), F.col("id").cast("string"), F.lit(".go")).alias("path"))
    rows = spark.range(500).select(F.lit("r").alias("root"), F.concat(F.lit("q/g"), F.col("id").cast("string"), F.lit(".go")).alias("path"), F.lit("go").alias("language"), F.lit(0).alias("pos"), F.lit('"x/p"').alias("import_text"))
    named = spark.createDataFrame([("r", "", "x")], "root string, dir string, module string")
    resolve.resolve(rows, known, named).select("path", "file").write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == out.distinct().count() == 500_000 and max(sizes) < 300_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 250_000
