"""Benchmark decontamination by a distributed positional inverted index.

Index: documents are indexed in blocks of bounded size, where they lie. A row of the stored index
is one block: its documents, its terms in order, and for each term the sorted list of its
positions. Nothing is shuffled, so no frequent term, passage or source gathers in one task.

Search: the test items' windows are looked up in every block. Of a window's terms the one with the
shortest list in the block comes first; its positions, moved back by its place in the window, are
kept where the next shortest list has the position that its own place asks for, and so on. A
window that lacks a term in the block costs one look at its terms. Proximity search takes the
rarest term's positions and asks for every other term within a slop of it.

The windows are sent to the executors in parts of at most ``PART_WORDS`` words, one part after the
other, so that neither the driver nor a task holds more than one. All parts go over the same stored
index; with more than one part, what documents with a hit have of each meets in one shuffle of hit
ranges. A task holds one block at a time, as views of the row it got.

Defined cases: null text has no words; a null item text has no window; items of one id count as
one item, and so do all without an id, which the digest leaves out; repeated doc_ids are judged row by row where the items fit in one part, and are told
apart by their place in the index otherwise; empty tables give no rows, an empty benchmark gives
clean documents; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the contract: A-Z lowered, and every byte that is not a digit, a letter or past ASCII a gap.
WORD_BYTES = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
WINDOW = 10
#: Bound of what is broadcast at once.
PART_WORDS = 2_000_000

INDEX = "block string, doc_ids array<long>, texts array<long>, bounds binary, terms binary, lists binary, positions binary"
_INDEX = ("block", "doc_ids", "texts", "bounds", "terms", "lists", "positions")
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def build(docs: DataFrame, block_bytes: int = 1_000_000) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi in common.slices(b.column(2), block_bytes):
                split = [words(t.as_py()) for t in b.column(2)[lo:hi]]
                flat = [w for ws in split for w in ws]
                bounds = np.cumsum([0, *map(len, split)]).astype("<u4")
                del split
                terms = sorted(set(flat))
                number = dict(zip(terms, range(len(terms)), strict=True))
                ids = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
                del flat, number
                positions = np.argsort(ids, kind="stable").astype("<u4")
                lists = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(terms)))]).astype("<u4")
                whole = (b" ".join(terms), lists, positions)
                del terms, ids
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{seq}"]), *[_listed(b.column(k)[lo:hi]) for k in (0, 1)], *[_cell(x) for x in (bounds, *whole)]], _INDEX)
                seq += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return common.stored_large(common.mapped(rows, index, INDEX), "postings")


def _cell(x: bytes | np.ndarray) -> pa.Array:
    """One binary value, not copied."""
    ends = np.array([0, len(x) if isinstance(x, bytes) else x.nbytes], np.int32)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _listed(values: pa.Array) -> pa.ListArray:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Block:
    """One row of the index, with lists as views of a batch's buffers."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.name, self.doc_ids, self.texts = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].values
        self.bounds, self.lists, self.positions = (np.frombuffer(batch.column(k)[i].as_buffer(), "<u4") for k in (3, 5, 6))
        terms = batch.column(4)[i].as_py()
        self._number = dict(zip(terms.split(b" "), range(len(self.lists)), strict=False)) if terms else {}

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        """The block's number of each term, -1 where it has none."""
        return np.fromiter((self._number.get(t, -1) for t in terms), np.int64, len(terms))

    def document_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the phrase, by intersecting lists from the rarest."""
        size = self.lists[terms + 1] - self.lists[terms]
        found = None
        for j in np.argsort(size, kind="stable").tolist():
            at = self.positions[self.lists[terms[j]] : self.lists[terms[j] + 1]].astype(np.int64) - j
            if found is None:
                found = at[at >= 0]
            else:
                k = np.searchsorted(at, found)
                k[k == len(at)] = 0
                found = found[at[k] == found]
            if not len(found):
                return found
        return found[self.document_of(found) == self.document_of(found + len(terms) - 1)]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term within ``slop`` words in the same
        document."""
        size = self.lists[terms + 1] - self.lists[terms]
        order = np.argsort(size, kind="stable").tolist()
        found = self.positions[self.lists[terms[order[0]]] : self.lists[terms[order[0]] + 1]].astype(np.int64)
        for j in order[1:]:
            at = self.positions[self.lists[terms[j]] : self.lists[terms[j] + 1]].astype(np.int64)
            doc = self.document_of(found)
            lo = np.searchsorted(at, np.maximum(found - slop, self.bounds[doc]))
            hi = np.searchsorted(at, np.minimum(found + slop, self.bounds[doc + 1].astype(np.int64) - 1), "right")
            found = found[hi > lo]
        return found


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for i in range(b.num_rows):
            yield Block(b, i)


class Windows:
    """Windows of test items: one stream of term numbers, and where distinct windows begin in it.

    A part of ``PART_WORDS`` words takes some forty bytes for each, is made once, on the driver, and is
    broadcast; a window is a slice of the stream."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WINDOW):
        number: dict[bytes, int] = {}
        split = [words(text) for _, text in items]
        size = np.fromiter(map(len, split), np.int64, len(split))
        self.stream = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int32, int(size.sum()))
        del split
        self.terms = list(number)
        ids: dict[str | None, int] = {}
        item = np.fromiter((ids.setdefault(i, len(ids)) for i, _ in items), np.int32, len(items))
        self.items = list(ids)
        bounds = np.concatenate([[0], np.cumsum(size)])
        #: of each width: (where windows begin, bounds of their owners, owners)
        self.by_width: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(np.minimum(size, width)).tolist():
            own = np.flatnonzero(np.minimum(size, width) == n)
            if n:
                count = size[own] - n + 1
                first = np.repeat(bounds[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                self.by_width.append((n, *self._distinct(n, first.astype(np.int32), np.repeat(item[own], count))))

    def _distinct(self, n: int, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that are equal become one with all its owners; they are found by a hash, and compared."""
        h = np.zeros(len(first), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.stream[first + k].astype(np.uint64)
            h ^= h >> np.uint64(29)
        order = np.lexsort((first, h))
        first, owner, h = first[order], owner[order], h[order]
        new = np.append(True, h[1:] != h[:-1])
        of = np.flatnonzero(new)[np.cumsum(new) - 1]
        for k in range(n):  # what only shares a hash is a window of its own
            new |= self.stream[first + k] != self.stream[first[of] + k]
        start = np.flatnonzero(new)
        key = np.unique((np.cumsum(new) - 1) * len(self.items) + owner)
        return first[start], np.searchsorted(key, np.arange(len(start) + 1) * len(self.items)), (key % len(self.items)).astype(np.int32)


def hits(block: Block, windows: Windows) -> tuple[np.ndarray, dict[int, set[str | None]]]:
    """Which words of the block are inside an occurrence, and each document's items."""
    n = int(block.bounds[-1])
    edge = np.zeros(n + 1, np.int32)
    items: dict[int, set[str | None]] = {}
    own = block.numbers(windows.terms).astype(np.int32)
    known = np.concatenate([[0], np.cumsum(own[windows.stream] >= 0, dtype=np.int32)])
    for width, first, bounds, owners in windows.by_width:
        for w in np.flatnonzero(known[first + width] - known[first] == width).tolist():
            starts = block.phrase(own[windows.stream[first[w] : first[w] + width]])
            if len(starts):
                edge[starts] += 1
                np.subtract.at(edge, starts + width, 1)
                for d in np.unique(block.document_of(starts)).tolist():
                    items.setdefault(d, set()).update(windows.items[i] for i in owners[bounds[w] : bounds[w + 1]].tolist())
    return np.cumsum(edge[:-1]) > 0, items


def _result(keys: pa.Array, texts: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, items: list) -> pa.RecordBatch:
    sha = [hashlib.sha256(",".join(sorted(i for i in x if i is not None)).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(np.asarray(n_hit) > 0), texts],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text_key"],
    )


def parts_of(items: DataFrame, part_words: int = PART_WORDS) -> Iterator[list[tuple[str | None, bytes]]]:
    """Test items (item_id, text) in parts whose size is bounded, one after the other."""
    part, held = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null").toLocalIterator():
        raw = r["t"].encode()
        if part and held + len(raw) // 2 > part_words:
            yield part
            part, held = [], 0
        part.append((r["i"], raw))
        held += len(raw) // 2
    yield part


def contamination(index: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS, text_key: bool = False) -> DataFrame:
    """Per indexed document: its words, those hit by any window, and the items that occur in it. With
    ``text_key`` also the xxhash64 of its text, which tells rows of one doc_id apart."""

    spark = index.sparkSession

    def judge(part: list[tuple[str | None, bytes]]):
        sent = spark.sparkContext.broadcast(Windows(part))  # bounded by part_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                hit, items = hits(block, sent.value)
                sums = np.concatenate([[0], np.cumsum(hit)])[block.bounds]
                yield _result(block.doc_ids, block.texts, np.diff(block.bounds.astype(np.int64)), np.diff(sums), [items.get(d, ()) for d in range(len(block.doc_ids))])

        return run

    def partial(part: list[tuple[str | None, bytes]]):
        """Of documents with a hit alone: their ranges of hit words, and items."""
        sent = spark.sparkContext.broadcast(Windows(part))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                hit, items = hits(block, sent.value)
                step = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                # a range of hit words may run over documents that follow each other
                ranges: dict[int, list[list[int]]] = {}
                for x, y in zip(step[::2].tolist(), step[1::2].tolist(), strict=True):
                    for d in range(int(block.document_of(np.array([x]))[0]), int(block.document_of(np.array([y - 1]))[0]) + 1):
                        s, e = int(block.bounds[d]), int(block.bounds[d + 1])
                        if max(x, s) < min(y, e):
                            ranges.setdefault(d, []).append([max(x, s) - s, min(y, e) - s])
                own = sorted(ranges)
                columns = {"block": pa.array([block.name] * len(own), pa.string()), "place": pa.array(own, pa.int32())}
                columns |= {"ranges": pa.array([ranges[d] for d in own], pa.list_(pa.list_(pa.int32()))), "items": pa.array([list(items.get(d, ())) for d in own], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(columns)

        return run

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            n = len(block.doc_ids)
            columns = {"block": pa.array([block.name] * n, pa.string()), "place": pa.array(range(n), pa.int32()), "doc_id": block.doc_ids, "text_key": block.texts, "n_words": pa.array(np.diff(block.bounds.astype(np.int64)))}
            yield pa.RecordBatch.from_pydict(columns)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges, items = b.column(3).to_pylist(), b.column(4).to_pylist()
            n_hit = []
            for lists in ranges:
                total = end = 0
                for x, y in sorted((x, y) for one in lists or () for x, y in one):
                    total, end = total + max(0, y - max(x, end)), max(end, y)
                n_hit.append(total)
            yield _result(b.column(0), b.column(1), b.column(2).to_numpy(), np.array(n_hit, np.int64), [{x for one in own or () for x in one} for own in items])

    result = RESULT + ", text_key long"
    parts = parts_of(benchmark, part_words)
    part, following = next(parts), next(parts, None)
    if following is None:
        out = common.mapped(index, judge(part), result)
        return out if text_key else out.drop("text_key")
    some = None
    while part is not None:
        one = common.mapped(index, partial(part), "block string, place int, ranges array<array<int>>, items array<string>")
        one = common.stored(one, "benchmark_part")
        some = one if some is None else some.unionAll(one)
        part, following = following, next(parts, None)
    met = some.groupBy("block", "place").agg(F.collect_list("ranges").alias("ranges"), F.collect_list("items").alias("items"))
    all_ = common.mapped(index, documents, "block string, place int, doc_id long, text_key long, n_words long")
    out = common.mapped(all_.join(met, ["block", "place"], "left").select("doc_id", "text_key", "n_words", "ranges", "items"), join, result)
    return out if text_key else out.drop("text_key")


def matches(index: DataFrame, queries: list[tuple[str, str]], slop: int | None = None) -> DataFrame:
    """Where each (query_id, text) occurs: exact phrases, or with ``slop`` all its words within so
    many words of its rarest. Rows (query_id, doc_id, position): the phrase's first word, or the
    rarest word. Queries are a stated set; each is taken whole."""
    split = [(q, words(t.encode())) for q, t in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for q, ws in split:
                terms = block.numbers(ws)
                if not len(terms) or (terms < 0).any():
                    continue
                at = block.phrase(terms) if slop is None else block.near(np.unique(terms), slop)
                doc = block.document_of(at)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([q] * len(at), pa.string()), "doc_id": block.doc_ids.take(pa.array(doc)), "position": pa.array(at - block.bounds[doc], pa.int64())})

    return common.mapped(index, run, "query_id string, doc_id long, position long")


#: The same result in DuckDB: windows of every document are compared with the items' windows.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS win
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win
  FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(x.n_items, 0) AS BIGINT) AS n_items, coalesce(x.s, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""
