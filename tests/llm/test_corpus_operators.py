"""Operators across documents and the pipeline: against brute force, planted cases and odd inputs."""

import hashlib
import random
import re
import weakref

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_text_operators import empty_documents, holds, odd_documents

import corpus_pipeline
from corpusloom.llm import langid, line_dedup, phrase_index, queries, simhash_golay, url_filter
from corpusloom.llm.components import components

SF = "/root/testdata/sf0.001"


def least_reachable(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


# -- components


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = np.random.default_rng(5)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(999, i) for i in range(200)] + [(999, 999)], "random": rng.integers(0, 300, (250, 2)).tolist(), "empty": []}[shape]
    edges = [*edges, *edges[:5], *[(b, a) for a, b in edges[:5]]]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 4), (5, None)], "a long, b long")).collect()}
    assert got == least_reachable({x for e in edges for x in e}, edges)


# -- decontamination


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        ws = brute_words(text)
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        ws = brute_words(text)
        hit, own = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if found := windows.get(tuple(ws[i : i + n])):
                    hit.update(range(i, i + n))
                    own |= found
        out.append((d, len(ws), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def ranked(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("part_words", [phrase_index.PART_WORDS, 300])
def test_contamination_against_brute_force(spark, part_words):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    planted = items.where("item_id = 0").first().text
    extra = [(9001, "x " + planted.upper().replace(" ", "--") + " y"), (9002, planted[:20]), (9003, " ".join(planted.split()[:10])), (9004, " ".join(planted.split()[:9])), (9005, None), (9006, ""), (None, planted)]
    docs = docs.unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    short = spark.createDataFrame([(7001, "Zyzzyva quux"), (7002, ""), (7003, None), (7004, "..."), (0, "a second text of item zero")], "item_id long, text string")
    items = items.unionAll(short)
    docs = docs.unionAll(spark.createDataFrame([(9007, "say zyzzyva, QUUX zyzzyva"), (9008, "quux zyzzyva")], "doc_id long, text string"))
    got = phrase_index.contamination(phrase_index.build(docs, block_bytes=50_000), items, part_words).collect()
    assert ranked(got) == ranked(brute_contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()]))


def test_contamination_odd_inputs(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma", "x")], "item_id long, text string, block string")
    docs = odd_documents(spark)
    got = phrase_index.contamination(phrase_index.build(docs), items).collect()
    assert ranked(got) == ranked(brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(1, "alpha beta gamma")]))
    assert phrase_index.contamination(phrase_index.build(empty_documents(spark)), items).count() == 0
    assert not any(r.contaminated for r in phrase_index.contamination(phrase_index.build(docs), items.limit(0)).collect())


@pytest.mark.parametrize("part_words", [phrase_index.PART_WORDS, 3])
def test_items_without_an_id_still_contaminate(spark, part_words):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, "a b c x y z"), (4, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (None, "b c"), ("i", "x y z")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in phrase_index.contamination(phrase_index.build(docs), items, part_words).collect()}
    none, own = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"i").hexdigest()
    # as the SQL has it
    assert got == {1: (3, 1, none, True), 2: (3, 1, own, True), 3: (6, 2, own, True), 4: (0, 0, none, False)}



def test_cells_let_go_of_their_arrays():
    """Else a worker keeps every list it ever wrote."""
    x = np.arange(1000, dtype="<u4")
    cell, held = phrase_index._cell(x), weakref.ref(x)
    assert cell[0].as_py() == x.tobytes() and phrase_index._cell(b"ab")[0].as_py() == b"ab" and phrase_index._cell(x[:0])[0].as_py() == b""
    del x, cell
    assert held() is None


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "cat the sat"), (3, "mat x x x x the cat"), (4, "the"), (5, "cat")], "doc_id long, text string")
    index = phrase_index.build(docs)
    exact = phrase_index.matches(index, [("q", "the cat"), ("r", "the mat"), ("none", "dog")]).collect()
    assert ranked(exact) == [("q", 1, 0), ("q", 3, 5), ("r", 1, 4)]
    near = {(r.query_id, r.doc_id) for r in phrase_index.matches(index, [("q", "cat mat")], slop=5).collect()}
    assert near == {("q", 1)}
    assert {r.doc_id for r in phrase_index.matches(index, [("q", "cat mat")], slop=6).collect()} == {1, 3}


# -- near duplicates


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(docs):
    fp = [(d, brute_fingerprint(t)) for d, t in docs]
    edges = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i][1] ^ fp[j][1]).bit_count() <= 2]
    top = least_reachable(range(len(fp)), edges)
    least = {}
    for i, (d, _) in enumerate(fp):
        if d is not None:
            least[top[i]] = min(least.get(top[i], d), d)
    return [(d, f"{f:016x}", least.get(top[i])) for i, (d, f) in enumerate(fp)]


@pytest.mark.parametrize("crowded", [32, 2])
def test_near_duplicates_against_brute_force(spark, crowded):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(d + 5000, t.upper() + " ") for d, t in docs[:30]] + [(d + 6000, t.replace("the", "teh", 1)) for d, t in docs[:60]]
    got = simhash_golay.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), crowded).collect()
    assert ranked(got) == ranked(brute_classes(docs))


def test_near_duplicates_odd_inputs(spark):
    docs = odd_documents(spark)
    got = simhash_golay.near_duplicates(docs).collect()
    assert ranked(got) == ranked(brute_classes([(r.doc_id, r.text) for r in docs.collect()]))
    assert simhash_golay.near_duplicates(empty_documents(spark)).count() == 0


def test_golay_code_is_perfect():
    error = simhash_golay.error_of()
    assert len(np.unique(error)) == 2048 and max(x.bit_count() for x in error.tolist()) == 3


def test_codewords_are_those_within_four_bits():
    words = np.arange(1 << 12) << 11
    words = words | simhash_golay.remainder(words)
    assert min(int(w).bit_count() for w in words[1:]) == 7
    for x in np.random.default_rng(2).integers(0, 1 << 23, 200):
        near = {int(w) >> 11 for w in words if int(w ^ x).bit_count() <= 4}
        got = set(simhash_golay.codewords(np.array([x]))[0].tolist())
        assert got == near and len(got) in (1, 6)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_keys_meet_within_two_bits(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    keys = [set(simhash_golay.join_keys(np.array([v], np.uint64))[1].tolist()) for v in (x, y)]
    assert keys[0] & keys[1]


@pytest.mark.parametrize("crowded", [1, 3, 1000])
def test_crowded_keys_link_the_same(spark, crowded):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    for _ in range(80):
        fps.add(rng.choice(list(fps)).item() ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))))
    fps = sorted(fps)
    got = [(r.a, r.b) for r in simhash_golay.links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowded).collect()]
    true = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    assert least_reachable(fps, got) == least_reachable(fps, true)


# -- lines


def edit(a, b):
    """Word edit distance, by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def brute_lines(docs):
    """(doc_id, text, exact, near) of documents of distinct ids."""
    seen, out = [], []
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        if text is None:
            out.append((d, None, 0, 0))
            continue
        kept, exact, near = [], 0, 0
        for line in text.split("\n"):
            ws = re.findall(r"[^ \t\r\f]+", line)
            if not ws:
                kept.append(line)
                continue
            if ws in seen:
                exact += 1
            elif len(ws) >= 5 and any(len(o) >= 5 and abs(len(o) - len(ws)) < 2 and edit(o, ws) < 2 for o in seen):
                near += 1
                seen.append(ws)
            else:
                kept.append(line)
                seen.append(ws)
        out.append((d, "\n".join(kept) if exact + near else text, exact, near))
    return out


def counted(docs):
    return [tuple(r) for r in line_dedup.clean(docs, ("x", "y")).select("doc_id", "text", "x", "y").collect()]


def test_lines_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("n_chars < 900").limit(40).collect()]
    base = "one two three four five six seven eight nine ten"
    ws = base.split()
    changed = [" ".join(ws[:i] + ["new"] + ws[i + 1 :]) for i in (0, 4, 5, 9)] + [" ".join(ws[:i] + ["new"] + ws[i:]) for i in (0, 5, 10)] + [" ".join(ws[:i] + ws[i + 1 :]) for i in (0, 5, 9)]
    two = " ".join(["a", *ws[1:-1], "b"])
    docs += [(9000 + i, f"{t}\n\n  {base}\t\n{t} ") for i, t in enumerate(changed)] + [(9100, two), (9101, base), (9102, "a b c d e\na b c d f\na b c d\nx b c d\n"), (9103, None), (9104, "\n\n"), (9105, ""), (None, base)]
    got = counted(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert ranked(got) == ranked(brute_lines(docs))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=4, max_size=8), min_size=1, max_size=25), st.integers(1, 4))
def test_lines_of_few_words(spark, lines, per):
    texts = ["\n".join(" ".join(x) for x in lines[i : i + per]) for i in range(0, len(lines), per)]
    docs = list(enumerate(texts))
    assert ranked(counted(spark.createDataFrame(docs, "doc_id long, text string"))) == ranked(brute_lines(docs))


@pytest.mark.parametrize("bits", [1, 5])
def test_keys_that_meet_by_chance_hide_no_neighbour(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "KEY_BITS", bits)
    base = [[f"w{i}x{j}" for j in range(7)] for i in range(12)]
    lines = [*base, *[[*x[:3], "new", *x[4:]] for x in base[::2]], *[x[1:] for x in base[1::3]], *base[:2]]
    docs = [(i, " ".join(x)) for i, x in enumerate(lines)]
    assert ranked(counted(spark.createDataFrame(docs, "doc_id long, text string"))) == ranked(brute_lines(docs))


def test_lines_odd_inputs(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "same words are here now", 1, "a"), (1, "same words are here now", 1, "a"), (2, long, 2, "b"), (3, long.replace("w77 ", ""), 3, "c"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long, _gonex string")
    got = line_dedup.clean(docs)
    assert got.columns == docs.columns
    assert ranked(got.select("doc_id", "text").collect()) == ranked([(1, "same words are here now"), (1, "same words are here now"), (2, long), (3, ""), (4, None)])
    assert line_dedup.clean(empty_documents(spark)).count() == 0


# -- addresses


def test_aliases_take_their_class_decision(spark):
    canonical = '<head><link href="{}" rel="canonical"></head>'
    refresh = "<META HTTP-EQUIV='refresh' content='0; URL={}'>"
    rows = [
        (1, "http://a.com/en/1", ""), (2, "http://plain.example/x", canonical.format("http://a.com/en/1")), (3, "https://third.example/y#z", refresh.format("http://plain.example/x")),
        (4, "http://sub.example.com/en/7", canonical.format("http://both.example/q")), (5, "http://both.example/q", canonical.format("http://bad.org/es/3")), (6, "http://bad.org/es/3", None),
        (7, "http://EXAMPLE.net/de/8?q", ""), (8, "http://x.net/de/8", ""), (9, None, canonical.format("/a")), (10, "no address", ""), (11, "http://rel.org/es/", canonical.format("/fr/")), (12, "http://rel.org/fr/", ""), (12, "http://rel.org/fr/", ""), (13, "http://xcom/en/", ""),
    ]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, node string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()}
    assert got == {
        1: ("a.com", "/en/1", "com/en/", "block"), 2: ("plain.example", "/x", None, "block"), 3: ("third.example", "/y", None, "block"),
        4: ("sub.example.com", "/en/7", "example.com/en/7", "allow"), 5: ("both.example", "/q", None, "allow"), 6: ("bad.org", "/es/3", "org/es/", "block"),
        7: ("example.net", "/de/8", "example.net/de/8", "block"), 8: ("x.net", "/de/8", "net/de/", "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"),
        11: ("rel.org", "/es/", "org/es/", "block"), 12: ("rel.org", "/fr/", None, "block"), 13: ("xcom", "/en/", None, "allow"),
    }
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_aliases_against_the_sql(spark):
    """Chains, stars and loops of aliases by whole addresses."""
    import duckdb

    rng = random.Random(4)
    urls = [f"http://{h}/{p}{i}" for i, (h, p) in enumerate((rng.choice(("a.com", "x.example.com", "b.net", "y.example.net", "c.org", "plain.io")), rng.choice(("en/", "de/", "es/", "en/7", "de/8", "q"))) for _ in range(120))]
    rows = []
    for i, u in enumerate(urls):
        to = rng.choice(urls[max(0, i - 5) : i + 6]) if rng.random() < 0.5 else None
        link = "" if to is None else f'<link rel="canonical" href="{to}">' if i % 2 else f'<meta http-equiv="refresh" content="0; url={to}">'
        rows.append((i, u, f"<html><head>{link}</head></html>"))
    rows += [(200, None, None), (201, "none", ""), (202, urls[3].upper().replace("HTTP", "http"), "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect())
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert got == sorted(con.execute(url_filter.ORACLE_SQL).fetchall())
    ruled = [r for r in got if r[3] is None and r[4] == "block"]
    assert ruled, "some page is blocked by an alias alone"


# -- the pipeline


def test_pipeline_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table)
    labels = list(langid.label([t or "" for _, t in docs], model))
    docs = [d for d, (lang, score, _) in zip(docs, labels) if lang != "und" and score >= langid.LEAST]
    docs = [(d, t) for d, t, x, y in brute_lines(docs) if not (x + y and not re.search(r"[^ \t\r\f\n]", t))]
    docs = [dt for dt, (d, _, least) in zip(docs, brute_classes(docs)) if d == least]
    docs = [dt for dt, r in zip(docs, brute_contamination(docs, items)) if not r[-1]]
    rows = corpus_pipeline.run(spark, SF).collect()
    bins = holds(rows, docs, 4096)
    assert bins <= -(-sum(r.length for r in rows) // 4096) + 1


def test_only_contaminated_rows_go(spark):
    """Rows of one doc_id, or without one, are judged each; columns of any name stay."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, "clean words of a first row", 1, "a"), (1, item, 2, "b"), (None, "another clean text", 3, "c"), (None, f"x {item}", 4, "d"), (2, item, 5, "e"), (3, None, 6, "f"), (None, None, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _same long, text_key string")
    got = corpus_pipeline.decontaminate(spark, docs, SF)
    assert got.columns == docs.columns and {r._same for r in got.collect()} == {1, 3, 6, 7}
    got = corpus_pipeline.lines(spark, docs.withColumnRenamed("text_key", "n_chars").withColumn("n_chars", F.lit(0).cast("long")).withColumn("_near", F.lit(1)), SF)
    assert got.columns == ["doc_id", "text", "_same", "n_chars", "_near"] and got.count() == 5


def test_stages_keep_the_columns_and_odd_rows_pass(spark):
    docs = odd_documents(spark).withColumnRenamed("n", "n_chars")
    for make in (lambda: docs, lambda: docs.limit(0)):
        at = make()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, SF)
            assert out.columns == at.columns, name
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() >= 0


def test_queries_run_and_have_their_sql(spark):
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 13)]
    assert set(queries.oracle_sql()) <= set(names)
    for name, query in names.items():
        assert query(spark, SF).columns, name


def test_a_full_part_of_a_benchmark_is_small_and_parts_give_the_same(spark):
    import pickle

    rnd = random.Random(5)
    vocabulary = [f"w{i}".encode() for i in range(100_000)]
    windows = phrase_index.Windows([(str(i), b" ".join(rnd.choices(vocabulary, k=100))) for i in range(phrase_index.PART_WORDS // 100)])
    assert len(windows.stream) == phrase_index.PART_WORDS and len(pickle.dumps(windows)) < 100e6
    few = [f"u{i}" for i in range(30)]
    items = [(f"i{i % 70}", " ".join(rnd.choices(few, k=rnd.choice((0, 3, 9, 10, 14))))) for i in range(90)] + [(None, "u1 u2 u3 u4"), ("i1", None), ("i2", "u1 u2 u3 u4")]
    docs = [(i, " ".join(rnd.choices(few, k=20)) + " " + rnd.choice(items[:90])[1] * (i % 2)) for i in range(60)] + [(7, None), (None, "u1 u2 u3 u4")]
    index = phrase_index.build(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=400)
    benchmark = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    got = [sorted(map(tuple, phrase_index.contamination(index, benchmark, part_words=n).collect()), key=str) for n in (phrase_index.PART_WORDS, 400, 60)]
    assert got[0] == got[1] == got[2] and len(list(phrase_index.parts_of(benchmark, 60))) > 3
    by_doc = {d: phrase for d, phrase in docs}
    for doc_id, n_words, n_hit, n_items, _, contaminated in got[0]:
        ws = brute_words(by_doc[doc_id])
        assert doc_id == 7 or n_words == len(ws)
        assert contaminated == (n_hit > 0) == (n_items > 0)


def test_very_many_near_lines_of_few_documents_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 20)
    docs = spark.createDataFrame([(d, "\n".join(f"one two three four five l{i} d{d}" for i in range(30))) for d in range(2)], "doc_id long, text string")
    lines = line_dedup.common.stored(line_dedup.hashed_lines(docs), "hashed_lines")
    again = line_dedup.common.stored(line_dedup.repeated(lines), "repeated_lines")
    plan = line_dedup.candidates(docs, lines, again)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan
