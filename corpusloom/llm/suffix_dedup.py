"""Exact removal of byte strings that occur more than once, by a distributed sparse suffix array.

A window is ``LENGTH`` bytes of one text. Every window that also starts anywhere else is removed, so what
has to be found is which windows have an equal. Four steps, of which the last is the suffix array:

* Anchors. Of a window's ``GRAM``-byte strings, the one of least hash, the leftmost of equals, is its
  anchor; it depends on the window's bytes alone, so equal windows have the same anchor at the same
  place. Windows that follow each other mostly share theirs: a stretch is such a run of windows, about
  85 of them, and is known by the hashes of its anchor (a) and of its bytes (s).
* Windows whose anchor occurs once in all texts have no equal. Where all stretches of an anchor are the
  same bytes, all their windows have equals, or none has. This settles most windows by counting hashes.
* What is left are anchors that stand in different stretches: edges of copied passages, edited copies.
  Their distinct stretches are the suffixes to sort, each from its anchor on, with the bytes before it.
* Sampled splitters range-partition the suffixes by their leading bytes and, where these are equal, by
  what stands before them, so that a hot suffix is split like any other. A bucket sorts its suffixes,
  and its reversed contexts, by multikey quicksort over tokens of eight bytes, level by level: only
  what was equal up to a token is compared in the next one. Common prefixes of neighbours then tell,
  for each place d of the anchor in a window, which suffixes share LENGTH - d bytes after the anchor's
  start and d before. Windows that could have an equal in another bucket, those that share a first or
  last suffix's bytes, are compared across the boundaries by digests of 128 bits: first, for ``BLOCK``
  places of the anchor at once, of the bytes that all these windows have, and only where such a core is in
  two buckets, of the windows themselves.

Texts are told apart by two 64-bit hashes; of equal texts one is looked at, and is removed whole if it
has a window at all. Distinct texts are stored once, bucketed by their hashes, so that they are shuffled
once; all else that moves is a few bytes for each stretch. A bucket holds ``BUCKET`` suffixes or so.

Defined cases: null text is empty; a text of fewer than ``LENGTH`` bytes keeps all; repeated doc_ids
are rows of their own; texts of any length are looked at in steps of ``STEP`` bytes; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a string that is removed where it repeats.
LENGTH = 200
#: Bytes of an anchor.
GRAM = 32
#: Bytes that are looked at together.
STEP = 1 << 20
#: Suffixes that a bucket has about.
BUCKET = 100_000
#: Windows of a suffix that are first compared together across buckets; as many as an int has bits, at most.
BLOCK = 24
#: Bits of a place among the bytes that are looked at together.
_PLACE = np.uint64((1 << (STEP + LENGTH).bit_length()) - 1)
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)

KEY = ("k1", "k2")
STRETCH = "k1 long, k2 long, a long, s long, start int, anchor int, n int, times int"
SUFFIX = "a long, s long, whole boolean, first int, right binary, left binary"
FOUND = "part int, a long, s long, lo int, hi int, h1 long, h2 long"
EDGE = "part int, a long, s long, d int, h1 long, h2 long"
RESULT = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place on."""
    h, factor, width = data.astype(np.uint64), _ODD, 1
    while width < GRAM:  # GRAM is a power of two
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, 2 * width
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values that follow each other."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, a, s, start, anchor, n, times) of the stretches of texts that lie end to end in ``data``
    between ``bounds``: places count from the text's start, and the same stretch over and over, as in
    one sign repeated, is one row with so many ``times``."""
    size, none = np.diff(bounds), np.zeros(0, np.int64)
    if len(data) < LENGTH or not (size >= LENGTH).any():
        return (none,) * 7
    h = gram_hashes(np.frombuffer(data, np.uint8))
    packed = least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
    at = np.flatnonzero(np.diff(packed, prepend=~packed[0]))
    # a stretch also ends with the last window of its text
    long = np.flatnonzero(size >= LENGTH)
    first, end = bounds[long], bounds[long + 1] - LENGTH + 1
    at = np.union1d(at, np.concatenate([first, end]))
    at = at[at < len(packed)]
    text = np.searchsorted(first, at, "right") - 1
    inside = (text >= 0) & (at < end[text])
    upto = np.append(at[1:], len(packed))[inside]
    at, text = at[inside], text[inside]
    anchor = (packed[at] & _PLACE).astype(np.int64)
    view = memoryview(data)
    s = np.fromiter((xxhash.xxh3_64_intdigest(view[x : y + LENGTH - 1]) for x, y in zip(at.tolist(), upto.tolist(), strict=True)), np.uint64, len(at)).view(np.int64)
    a, n = h[anchor].view(np.int64), upto - at
    new = np.ones(len(at), bool)
    new[1:] = (s[1:] != s[:-1]) | (a[1:] != a[:-1]) | (n[1:] != n[:-1]) | (at[1:] != upto[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    times = np.diff(np.append(run, len(at)))
    base = first[text]
    return tuple(x[run] for x in (long[text], a, s, at - base, anchor - base, n)) + (times,)


def pieces(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, number of each text, place where it begins in it): texts end to end up to ``STEP``
    bytes, longer ones cut so that every window is in one piece."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = memoryview(texts.buffers()[2]) if texts.buffers()[2] else memoryview(b"")
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + STEP, "right")) - 1)
        if ends[j] - ends[i] <= STEP:
            yield bytes(data[ends[i] : ends[j]]), ends[i : j + 1] - ends[i], np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for x in range(0, int(ends[j] - ends[i]), STEP):
                part = bytes(data[ends[i] + x : min(ends[j], ends[i] + x + STEP + LENGTH - 1)])
                yield part, np.array([0, len(part)]), np.array([i]), np.array([x])
        i = j


def anchored(texts: DataFrame) -> DataFrame:
    """The stretches of ``texts`` (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, bounds, number, begins in pieces(b.column(2)):
                text, a, s, start, anchor, n, times = stretches(data, bounds)
                row, begin = number[text], begins[text]
                places = [pa.array(x, pa.int32()) for x in (start + begin, anchor + begin, n, times)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row)) for k in (0, 1)), pa.array(a), pa.array(s), *places], ["k1", "k2", "a", "s", "start", "anchor", "n", "times"])

    return common.mapped(texts.select(*KEY, F.col("text").cast("binary").alias("text")), run, STRETCH)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each text (k1, k2, text, copies), stored in buckets by its hashes: what is joined with it later is
    dealt to these, and no text is shuffled again."""
    spark = docs.sparkSession
    one = keyed(docs).groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    return common.stored_bucketed(one, name, int(spark.conf.get("spark.sql.shuffle.partitions")), KEY)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})


def repeated(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stretches of anchors that occur more than once with ``contested``, whether the anchor stands in
    several stretches; of these the distinct ones, with one place, and ``whole``, whether it repeats)."""
    place = F.xxhash64(*KEY, "start")
    # hashes of places, so that partial sums are kept by key in fixed space
    ends = [F.min("p").alias("p0"), F.max("p").alias("p1"), F.max("times").alias("most")]
    again = (F.col("p0") != F.col("p1")) | (F.col("most") > 1)
    anchors = found.select("a", "s", "times", place.alias("p")).groupBy("a").agg(*ends, F.min("s").alias("s0"), F.max("s").alias("s1"))
    anchors = common.stored(anchors.where(again).select("a", (F.col("s0") != F.col("s1")).alias("contested")), "repeated_anchors")
    some = common.stored(found.join(anchors, "a"), "repeated_stretches")
    first = [F.first(c).alias(c) for c in (*KEY, "start", "anchor", "n")]
    distinct = some.where("contested").withColumn("p", place).groupBy("a", "s").agg(*ends, *first).select("a", "s", *KEY, "start", "anchor", "n", again.alias("whole"))
    return some, common.stored(distinct, "contested_stretches")


def suffixes(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """The bytes of distinct stretches: ``right`` from the anchor on, ``left`` before it, and ``first``,
    how far the anchor is from the start of the last window."""
    wanted = distinct.groupBy(*KEY).agg(F.collect_list(F.struct("a", "s", "whole", "start", "anchor", "n")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = memoryview(text.as_buffer())
                for w in wanted:
                    x, q, end = w["start"], w["anchor"], w["start"] + w["n"] + LENGTH - 1
                    rows.append((w["a"], w["s"], w["whole"], q - (x + w["n"] - 1), bytes(data[q:end]), bytes(data[x:q])))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], [x.split()[0] for x in SUFFIX.split(", ")])

    both = texts.join(wanted, list(KEY)).select(F.col("text").cast("binary").alias("text"), "wanted")
    return common.mapped(both, run, SUFFIX)


def matrix(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` bytes, filled up with zeros."""
    return np.array(strings, f"S{width}").view(np.uint8).reshape(len(strings), width)


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes by multikey quicksort over tokens of eight bytes: groups that are equal
    so far are sorted by their next token, all groups of a level at once."""
    tokens = rows.view(">u8").astype(np.uint64)
    order = np.arange(len(rows))
    group, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for level in range(tokens.shape[1]):
        key = tokens[order[live], level]
        by = np.lexsort((key, group[live]))
        order[live], key = order[live][by], key[by]
        own = group[live]  # in the order of groups, and so unchanged by the sort
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(live)))
        group[live] = np.repeat(live[start], size)
        live = live[np.repeat(size > 1, size)]
        if not len(live):
            break
    return order


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row begins with as the one before; -1 for the first."""
    out = np.full(len(rows), -1, np.int64)
    for i in range(1, len(rows), 1 << 16):
        j = min(len(rows), i + (1 << 16))
        other = rows[i:j] != rows[i - 1 : j - 1]
        out[i:j] = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return out


def bucket_windows(first: np.ndarray, right: list[bytes], left: list[bytes], edges: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's distinct suffixes, by place d of the anchor in the window and suffix: which windows have an
    equal here, and which, of equal ones one, could have one in another bucket."""
    m, width = len(right), LENGTH - GRAM
    rows, back = matrix(right, LENGTH), matrix([x[::-1] for x in left], width)
    last = np.fromiter(map(len, left), np.int64, m)
    kinds = []
    for r in (rows, back):
        order = multikey_order(r)
        kinds.append((order, common_prefixes(r[order])))
    (by_right, right_common), (by_left, left_common) = kinds
    equal, border = np.zeros((width + 1, m), bool), np.zeros((width + 1, m), bool)
    group, other = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(width + 1):
        have = np.flatnonzero((first <= d) & (d <= last))
        if not len(have):
            continue
        group[by_right], other[by_left] = np.cumsum(right_common < LENGTH - d), np.cumsum(left_common < d)
        key = group[have] * (m + 1) + other[have]
        by = np.argsort(key, kind="stable")
        key, own = key[by], have[by]
        new = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(own)))
        equal[d, own] = np.repeat(size > 1, size)
        if edges:
            one = own[start]
            border[d, one] = np.isin(group[one], (group[by_right[0]], group[by_right[-1]]))
    return equal, border


def digests(parts: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers of each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), ">i8").reshape(-1, 2).astype(np.int64)


def sorted_windows(some: DataFrame, parts: int) -> DataFrame:
    """Rows of FOUND: windows of suffixes (a, s) that have an equal, by ranges ``lo`` to ``hi`` of the
    anchor's place; and, where windows may have one in another bucket, the number of their block (lo),
    which of its windows these are (bits of hi), and the digest of their core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        a, s, whole, first = (t.column(k).to_numpy() for k in range(4))
        right, left = t.column(4).to_pylist(), t.column(5).to_pylist()
        del held, t
        equal, border = bucket_windows(first, right, left, parts > 1)
        equal[:, whole] = False  # known, and so not told again; they are here to be met
        step = np.diff(np.pad(equal, ((1, 1), (0, 0))).astype(np.int8), axis=0).T
        (i, lo), (_, hi) = np.nonzero(step == 1), np.nonzero(step == -1)
        bits = np.stack([np.left_shift(border[x : x + BLOCK], np.arange(len(border[x : x + BLOCK]))[:, None]).sum(axis=0) for x in range(0, len(border), BLOCK)])
        block, at = np.nonzero(bits)
        ends = np.minimum((block + 1) * BLOCK, len(border)) - 1
        core = digests([left[k][len(left[k]) - x :] + right[k][: LENGTH - y] for k, x, y in zip(at.tolist(), (block * BLOCK).tolist(), ends.tolist(), strict=True)])
        n = len(i)
        both = lambda x, y: pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())])
        columns = [pa.array([part] * (n + len(at)), pa.int32()), both(a[i], a[at]), both(s[i], s[at]), both(lo, block).cast(pa.int32()), both(hi - 1, bits[block, at]).cast(pa.int32())]
        columns += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(core[:, k])]) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return common.mapped(some.repartitionByRange(parts, "right", F.reverse("left")), run, FOUND)


def edge_windows(some: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of EDGE: the windows of ``wanted`` blocks (part, a, s, lo, hi), with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, strings = [], []
            for part, a, s, block, bits, right, left in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for d in (block * BLOCK + k for k in range(BLOCK) if bits >> k & 1):
                    rows.append((part, a, s, d))
                    strings.append(left[len(left) - d :] + right[: LENGTH - d])
            found = digests(strings)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[:, 0]), pa.array(found[:, 1])], [x.split()[0] for x in EDGE.split(", ")])

    return common.mapped(wanted.join(some, ["a", "s"]).select("part", "a", "s", "lo", "hi", "right", "left"), run, EDGE)


def in_two_buckets(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` whose ``key`` is that of a row of another ``part``."""
    across = rows.groupBy(*key).agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select(*key)
    return rows.join(across, list(key), "left_semi")


def windows(texts: DataFrame, distinct: DataFrame, n: int) -> DataFrame:
    """Ranges (a, s, lo, hi) of windows, in distinct stretches that occur once, that have an equal."""
    spark = texts.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000), -(-n // BUCKET))
    some = common.stored(suffixes(texts, distinct), "suffixes")
    found = common.stored(sorted_windows(some, parts), "sorted_suffixes")
    edge = in_two_buckets(found.where("h1 is not null"), "lo", "h1", "h2").select("part", "a", "s", "lo", "hi")
    met = in_two_buckets(common.stored(edge_windows(some, edge), "edge_windows"), "h1", "h2").select("a", "s", F.col("d").alias("lo"), F.col("d").alias("hi"))
    return found.where("h1 is null").select("a", "s", "lo", "hi").unionAll(met)


def spans(some: DataFrame, distinct: DataFrame, within: DataFrame) -> DataFrame:
    """Byte ranges (k1, k2, x, y) that windows with an equal cover."""
    end = F.col("start") + F.col("n") * F.col("times") + F.lit(LENGTH - 1)
    plain = some.where("not contested").select(*KEY, F.col("start").alias("x"), end.alias("y"))
    repeats = some.where("contested").join(distinct.where("whole").select("a", "s"), ["a", "s"]).select(*KEY, F.col("start").alias("x"), end.alias("y"))
    partly = distinct.where("not whole").select("a", "s", *KEY, "anchor").join(within, ["a", "s"])
    partly = partly.select(*KEY, (F.col("anchor") - F.col("hi")).alias("x"), (F.col("anchor") - F.col("lo") + LENGTH).alias("y"))
    return plain.unionAll(repeats).unionAll(partly)


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges that overlap or touch, as one."""
    out: list[list[int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct texts with their hashes, the byte ranges of each that are removed)."""
    texts = distinct_texts(docs)
    found = anchored(texts)
    some, distinct = repeated(found)
    n = distinct.count()
    return texts, spans(some, distinct, windows(texts, distinct, n))


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document; with ``keep_text`` also
    ``kept``, the bytes that stay, which may end within a letter."""
    texts, gone = removed(docs)
    by_text = gone.groupBy(*KEY).agg(F.collect_list(F.struct("x", "y")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in range(5)]
            for text, copies, gone in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                data = memoryview(text.as_buffer())
                cut = [[0, len(data)]] if copies > 1 and len(data) >= LENGTH else merged([(r["x"], r["y"]) for r in gone or ()])
                stays = [data[x:y] for x, y in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), len(data)], strict=True)]
                sha = hashlib.sha256()
                for part in stays:
                    sha.update(part)
                row = (len(data), sum(y - x for x, y in cut), len(cut), sha.hexdigest(), b"".join(stays) if keep_text else b"")
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: 5 if keep_text else 4]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names)

    schema = RESULT + (", kept binary" if keep_text else "")
    names = [x.split()[0] for x in schema.split(", ")]
    judged = common.mapped(texts.join(by_text, list(KEY), "left").select(*KEY, F.col("text").cast("binary").alias("text"), "copies", "gone"), run, schema)
    return keyed(docs).select("doc_id", *KEY).join(judged, list(KEY)).drop(*KEY)


def kept_text(kept: Column) -> Column:
    """Bytes that stay as text; letters that a cut broke become U+FFFD."""
    return F.decode(kept, "UTF-8")


#: The same result in DuckDB: all windows of all texts are grouped by a hash.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + {LENGTH - 1}]) AS h FROM d, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS t(i)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
gap AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM gap),
span AS (SELECT r, min(i) AS x, max(i) + {LENGTH - 1} AS y FROM run GROUP BY r, k),
cut AS (SELECT r, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys, sum(y - x + 1) AS gone, count(*) AS n FROM span GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n IS NULL THEN b ELSE list_reduce(list_transform(range(1, n + 2), lambda k: CASE WHEN coalesce(ys[k - 1], 0) + 1 > coalesce(xs[k] - 1, octet_length(b)) THEN ''::BLOB ELSE b[coalesce(ys[k - 1], 0) + 1:coalesce(xs[k] - 1, octet_length(b))] END), lambda p, q: p || q) END) AS kept_sha256
FROM d LEFT JOIN cut ON d.r = cut.r
"""
