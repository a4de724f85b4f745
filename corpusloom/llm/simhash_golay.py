"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in
at most 2 bits agree wholly in at least one segment (pigeonhole), and in each other segment differ
by at most 2 bits. The perfect Golay code of length 23 has a codeword within 3 bits of every word;
for two segments at most 2 bits apart, the codeword nearest to a word between them is within 4 bits
of both. So a segment's keys are its codewords within 4 bits (one, or six), found by decoding the
segment and its 23 one-bit changes. A fingerprint's join keys are, for each segment, that segment
as it is and the codewords of the next one: about 16 keys of 33 bits that no link escapes.

Only distinct fingerprints are joined, so copies cost nothing. Keys that few fingerprints share are
joined and verified pair by pair. Where more than ``crowded`` fingerprints share a key (a large
group of near copies), they are linked exactly without pairs: two fingerprints are within 2 bits
just if they have a common word within one bit, so each is sent to its 65 words of that kind and
linked to the least fingerprint there. Every pair of such a group is within 2 bits, so the links
need no check and connect the same documents.

Defined cases: null or empty text has no words and fingerprint zero, which links like any other;
repeated doc_ids are separate rows; a null doc_id never names a component (a component of only
such rows has a null id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Fixed by the contract: the white space between words, A-Z lowered.
SPACES = bytes((0x20 if c in (0x20, 9, 10, 11, 12, 13) else c | 0x20 if 0x41 <= c <= 0x5A else c) for c in range(256))
SHINGLE, SEED, BITS = 3, 42, 2
#: Fixed: the generator polynomial of the binary Golay code of length 23, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: (shift, bits) of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))


def fingerprint(text: bytes) -> int:
    """SimHash of a text's 3-word shingles: a bit is set if set in over half their hashes."""
    import xxhash

    ws = text.translate(SPACES).split(b" ")
    ws = [w for w in ws if w] if b"" in ws else ws
    if not ws:
        return 0
    shingles = map(b" ".join, zip(ws, ws[1:], ws[2:], strict=False)) if len(ws) >= SHINGLE else [b" ".join(ws)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # very long texts in steps
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp long) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [signed(fingerprint(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return common.mapped(rows, run, "doc_id long, fp long")


def remainder(x: np.ndarray) -> np.ndarray:
    """Of words of 23 bits as polynomials over GF(2), modulo the generator: the syndrome."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (GENERATOR << (bit - 11))
    return x


@cache
def error_of() -> np.ndarray:
    """The only error pattern of at most 3 bits with each syndrome."""
    bit = 1 << np.arange(23)
    one = np.concatenate([[0], bit])
    patterns = np.unique(one[:, None, None] | one[None, :, None] | one[None, None, :])
    table = np.zeros(2048, np.int64)
    table[remainder(patterns)] = patterns
    return table


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each segment, a row each: decodings of
    the segment and of its 23 one-bit changes. A row repeats what it has fewer of."""
    near = segment[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    return (near ^ error_of()[remainder(near)]) >> 11


def join_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) for the join keys of unsigned fingerprints."""
    rows, keys = [], []
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    for i in range(3):
        code = np.sort(codewords(parts[(i + 1) % 3]), axis=1)
        new = np.concatenate([np.ones((len(fp), 1), bool), code[:, 1:] != code[:, :-1]], axis=1)
        row, col = np.nonzero(new)
        rows.append(row)
        keys.append(np.int64(i << 40) | parts[i][row] << 12 | code[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def links(fps: DataFrame, crowded: int = 32) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect just those that chains of
    links of at most 2 bits connect."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            row, key = join_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["k", "fp"])

    keyed = common.stored(common.mapped(fps.select("fp"), emit, "k long, fp long"), "golay_keys", "lz4")
    shared = common.stored(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "golay_shared", "lz4")
    few = keyed.join(shared.where(F.col("n") <= crowded).select("k"), "k")
    pairs = few.select("k", F.col("fp").alias("a")).join(few.select("k", F.col("fp").alias("b")), "k").where("a < b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")

    many = keyed.join(shared.where(F.col("n") > crowded).select("k"), "k", "left_semi").select("fp").distinct()
    words = F.concat(F.array(F.col("fp")), F.array(*[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)]))
    near = many.select("fp", F.explode(words).alias("w"))
    least = near.groupBy("w").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("w", "a")
    stars = near.join(least, "w").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, crowded: int = 32) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) of ``docs`` (doc_id, text)."""
    own = common.stored(fingerprints(docs), "fingerprints", "lz4")
    fps = common.stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints", "lz4")
    comp = components(links(fps, crowded))
    # a component's id is the least doc_id of all its fingerprints
    named = fps.join(comp, fps["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    ids = named.groupBy("c").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "c").join(ids, "c").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(by_fp, "fp").select("doc_id", text, "component_id")
