"""Token ids of a corpus as binary shard files: one concatenated id array per file, with the document
boundaries and document ids in Elias-Fano form.

File layout, little-endian: magic, counts, then three parts: the boundaries, the doc_ids, the ids
(unsigned 16 or 32 bit). An Elias-Fano part holds the low bits packed, the high bits in unary, and
the position of every 256th one as select samples, so that ``select`` reads a few bytes and no table
of 64-bit offsets exists, in the file or in memory. Any reader can map a file and take a document
from it; ``Shard`` does so.

Plan: range-partition by doc_id (one shuffle of the texts), sort, tokenize in order. Each task writes
its files to the shared folder by Arrow's file systems (``file``, ``hdfs``, ``s3``, ...), under names
of its own attempt, and their names and counts are stored as a table: only files of attempts that
ended well are in it, so lost executors and attempts that run twice change nothing. Only one total
per partition comes to the driver. Reading deals the files out and shuffles no ids: a file knows
where it starts within its partition.

Defined cases: null text is empty (one id, the end id); null doc_ids come first; repeated doc_ids
are kept, ordered by a hash of the text; an empty table gives no file and no row; other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir
from . import common, tokens

MAGIC = b"EFTOKENS"
_HEAD = struct.Struct("<8sQQQBQQQ")  # magic, documents, ids, ids before it in the partition, bytes an id, sizes of two parts, null doc_ids
_EF = struct.Struct("<QQqBQQ")  # count, universe, base, low bits, bytes of lows and of highs
SAMPLE = 256

#: Ids that a reader holds at once, or those of one longer document.
HELD = 1 << 20

SHARDS = "part int, seq int, file string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of integers near its minimal space, with select."""

    def __init__(self, raw: bytes):
        n, _, base, low, nl, nh = _EF.unpack_from(raw)
        at = _EF.size
        self.n, self.base, self.low = n, base, low
        self._low = raw[at : at + nl]
        self._high = raw[at + nl : at + nl + nh]
        self._sample = np.frombuffer(raw, "<u4", -(-n // SAMPLE), at + nl + nh)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        base = int(values[0]) if n else 0
        v = values.astype(np.int64).astype(np.uint64) - np.uint64(base & (2**64 - 1))  # modulo 2**64: any int64 range fits
        top = int(v[-1]) if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        highs = np.packbits(unary, bitorder="little").tobytes()
        return _EF.pack(n, top, base, low, len(lows), len(highs)) + lows + highs + ones[::SAMPLE].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """Value i, from its low bits and the place of the i-th one, counted from the nearest sample in
        steps of 64 bits."""
        at = int(self._sample[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        window = int.from_bytes(self._high[byte : byte + 8], "little") >> (at % 8) << (at % 8)
        while (c := window.bit_count()) <= left:
            left -= c
            byte += 8
            window = int.from_bytes(self._high[byte : byte + 8], "little")
        for _ in range(left):
            window &= window - 1
        high = byte * 8 + (window & -window).bit_length() - 1 - i
        first = i * self.low
        chunk = int.from_bytes(self._low[first // 8 : (first + self.low + 7) // 8], "little")
        low = (chunk >> (first % 8)) & ((1 << self.low) - 1)
        return self.base + (high << self.low | low)


def write_shard(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray, before: int) -> bytes:
    """A shard of documents whose ids lie on end, document i from bounds[i]."""
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    known = [d for d in doc_ids if d is not None]
    ef, docs = EliasFano.encode(bounds), EliasFano.encode(np.array(known, np.int64))
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), before, width, len(ef), len(docs), len(doc_ids) - len(known))
    return head + ef + docs + ids.astype(f"<u{width}").tobytes()


def opened(file: str) -> pa.NativeFile:
    """A shard file at an address in the shared folder."""
    fs, path = pyarrow.fs.FileSystem.from_uri(file)
    return fs.open_input_file(path)


class Shard:
    """Random access to the documents of a shard file: its head and boundaries are read, ids only where
    they are asked for."""

    def __init__(self, file: pa.NativeFile):
        self._file = file
        magic, self.n_docs, self.n_ids, self.before, self.width, nb, nd, self.nulls = _HEAD.unpack(file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self._at = _HEAD.size + nb + nd
        self.bounds, self.docs = EliasFano(file.read_at(nb, _HEAD.size)), EliasFano(file.read_at(nd, _HEAD.size + nb))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self._file.read_at((hi - lo) * self.width, self._at + lo * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.docs.select(i - self.nulls)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's place, ids) of every document, reading HELD ids or one document at once."""
        at = lo = hi = 0
        held = np.zeros(0, np.uint32)
        for i in range(self.n_docs):
            end = self.bounds.select(i + 1)
            if end > hi:
                lo, hi = at, max(end, min(at + HELD, self.n_ids))
                held = self.ids(lo, hi)
            yield self.doc_id(i), at, held[at - lo : end - lo]
            at = end


def write(docs: DataFrame, path: str | None = None, shard_bytes: int = 8_000_000) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) into shard files of so many bytes of text, or one longer text, in
    ascending doc_id; the stored table of them."""
    path = path or tokens.default_path()
    place = f"{shared_dir(docs.sparkSession)}/token_files-{uuid.uuid4().hex}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part, attempt = tokens.tokenizer(path), TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = pyarrow.fs.FileSystem.from_uri(place)
        seq = before = held = 0
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        size: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, before, held
            flat, bounds = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(size))])
            name = f"{part:06d}-{seq:06d}-{attempt}.ids"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(write_shard(keys, flat, bounds, before))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [f"{place}/{name}"], "n_docs": [len(keys)], "n_ids": [len(flat)]})
            seq, before, held = seq + 1, before + len(flat), 0
            for x in (keys, ids, size):
                x.clear()
            return row

        for b in batches:
            for lo, hi in common.slices(b.column(1), min(shard_bytes, tokens.TEXT_BYTES)):
                texts = b.column(1)[lo:hi]
                if held and held + texts.nbytes > shard_bytes:
                    yield close()
                own, bounds = tok.documents(texts)
                keys += b.column(0)[lo:hi].to_pylist()
                ids.append(own.astype(np.uint32))
                size.append(np.diff(bounds))
                held += texts.nbytes
        if keys:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return common.stored(common.mapped(ordered, encode, SHARDS), "shards")


def read(shards: DataFrame) -> DataFrame:
    """One row per document of stored shard files: its offset in the whole corpus, its count of ids and
    their checksum. The totals that the driver takes are one number per partition written."""
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, sofar = {}, 0
    for part in sorted(totals):
        base[part], sofar = sofar, sofar + totals[part]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with opened(file) as f:
                    s = Shard(f)
                    got = [(d, at + base[part] + s.before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in s.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = shards.select("part", "file").repartition(max(1, len(totals)))
    return common.mapped(dealt, rows, ROWS)
