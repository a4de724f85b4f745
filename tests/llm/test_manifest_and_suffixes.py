"""The Merkle manifest and suffix dedup against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from corpusloom.llm import merkle, suffix_dedup

DOCS = "doc_id long, source string, lang string, n_chars int, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    fields = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree_of(hashes, fanout):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def way_of(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        first = i // fanout * fanout
        out.append((i - first, nodes[first : first + fanout]))
        i //= fanout
    return out


def manifest_of(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([leaf_of(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))], fanout) for g in order}
    top = tree_of([trees[g][-1][0] for g in order], fanout)
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))):
            way = way_of(trees[g], i, fanout) + way_of(top, k, fanout)
            got = leaf_of(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf_of(r)
            for place, run in way:
                got = sha(*run[:place], got, *run[place + 1 :])
            proof = sha(*[x for place, run in way for j, x in enumerate(run) if j != place])
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], proof, got, got == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "run", "merged", "fanout"), [(300, 17, 2, 2), (120, 11, 3, 3), (1, 5, 2, 2), (50, 1000, 256, 2), (0, 5, 2, 2)])
def test_manifest_over_unaligned_runs_is_the_plain_tree(spark, monkeypatch, n, run, merged, fanout):
    monkeypatch.setattr(merkle, "RUN", run)
    monkeypatch.setattr(merkle, "MERGED", merged)
    rnd = random.Random(n)
    rows = [(rnd.choice([None, i, i, i, i // 2]), rnd.choice(["a", None]), rnd.choice(["en"] * 3 + ["de", "zé", None, ""]), rnd.choice([None, 5, 7]), rnd.choice([None, "", "héllo", "x" * rnd.randint(1, 50)])) for i in range(n)]
    rows += rows[:5] if n > 10 else []
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS + ", pos int, g string")
    assert sorted(map(tuple, merkle.verify(docs, fanout).collect()), key=str) == (manifest_of(rows, fanout) if rows else [])
    kept = [tuple(r) for r in merkle.node_records(docs, fanout).collect()]
    assert len(kept) == len({k[:3] for k in kept})
    groups = Counter(r[2] for r in rows)
    assert len(kept) == sum(sum(merkle.sizes(c, fanout)) for c in groups.values())


def test_a_stack_carries_peaks_of_an_unaligned_run():
    nodes, peaks = {}, []
    m = merkle.Mountains(3, 9, 2, lambda level, j, x: nodes.__setitem__((level, j), x), lambda level, j, x: peaks.append((level, j)))
    for x in "defghi":
        m.push(x)
    m.finish()
    # 3 | 4 5 6 7 | 8: the pairs 4-5 and 6-7 meet; 8 is alone on its level and the next two, and waits for 0-7 there
    assert peaks == [(0, 3), (2, 1), (3, 1)]
    assert nodes[1, 4] == sha("i") and nodes[2, 1] == sha(sha("ef"), sha("gh")) and nodes[3, 1] == sha(sha(sha("i")))


def removed_of(rows, length):
    coded = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in coded for i in range(len(b) - length + 1))
    out = []
    for d, b in coded:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def copied_texts(seed):
    """Texts with passages cut at random places, edited copies, texts of one sign, equal and odd ones."""
    rnd = random.Random(seed)
    text = lambda n: "".join("".join(rnd.choice("abcdefgé ") for _ in range(rnd.randint(1, 6))) for _ in range(n))
    passages = [text(120) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            x = rnd.randint(0, 100)
            p = rnd.choice(passages)[x : x + rnd.randint(150, 400)]
            if rnd.random() < 0.4:
                q = rnd.randint(0, len(p) - 1)
                p = p[:q] + "#" + p[q + 1 :]
            parts += [p, text(rnd.randint(0, 30))]
        rows.append((i, "".join(parts)))
    odd = [None, "", "x" * 5000, "ab" * 700, "x" * 250, "y" * 199, "y" * 200, rows[5][1], "\0" * 300, "abc" * 90 + "q", "v" * 199 + "w", "u" + "v" * 199]
    return rows + [(200 + i, t) for i, t in enumerate(odd)] + [(5, rows[5][1]), (None, "z" * 201)]


@pytest.mark.parametrize(("seed", "bucket", "step"), [(1, 100_000, 1 << 20), (2, 7, 1 << 20), (3, 40, 300)])
def test_suffix_dedup_removes_what_a_table_of_all_windows_says(spark, monkeypatch, seed, bucket, step):
    """Small buckets put every boundary to the test, small steps every cut of a long text."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rows = copied_texts(seed)
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, k1 int, copies string")
    assert sorted(map(tuple, suffix_dedup.dedup(docs).collect()), key=str) == removed_of(rows, suffix_dedup.LENGTH)


def test_suffix_dedup_of_nothing_and_its_kept_text(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "head " + "q" * 150 + "r" * 150), (2, "q" * 150 + "r" * 150 + " tail"), (3, None)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True)
    assert {r["doc_id"]: r["t"] for r in got.select("doc_id", suffix_dedup.kept_text(got["kept"]).alias("t")).collect()} == {1: "head ", 2: " tail", 3: ""}


def test_multikey_order_is_the_order_of_bytes():
    rnd = random.Random(1)
    rows = [bytes(rnd.choice((0, 1, 255)) for _ in range(rnd.choice((0, 3, 8, 17, 24)))) for _ in range(500)]
    m = suffix_dedup.matrix(rows, 24)
    order = suffix_dedup.multikey_order(m)
    padded = [r.ljust(24, b"\0") for r in rows]
    assert [padded[i] for i in order] == sorted(padded)
    common = suffix_dedup.common_prefixes(m[order])
    for x, y, n in zip(order[:-1], order[1:], common[1:], strict=True):
        assert padded[x][:n] == padded[y][:n] and (n == 24 or padded[x][n] != padded[y][n])
