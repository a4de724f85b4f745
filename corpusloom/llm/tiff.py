"""TIFF media columns: write texts as pages of samples, and read any page back.

``read`` walks the chain of image directories of classic TIFF and BigTIFF in either byte order,
decodes strips or tiles that are plain, PackBits, LZW or deflate, undoes horizontal and
floating-point predictors, joins planes, and gives one row per page. ``store`` writes a payload as
8-bit grey pages. Both are narrow: no shuffle, a bounded batch at a time.

Defined cases: null or empty text is a payload of 64 zero bytes; equal texts give equal bytes;
what can't be read of a file gives one row with ``error`` and no samples, after the pages before it;
sizes that a file can't hold are errors before anything is taken for them, and a page has
``MOST_PAGE`` bytes at most; a file without a page has an error too; ``digest`` of a file with an
error has null in place of a payload, and the error; repeated rows are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the format: tag numbers, compressions, and bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}

#: The most bytes of a page.
MOST_PAGE = 1 << 30

LINE = 64
#: Rows of 64 samples in a strip and in a page of a stored payload.
STRIP_ROWS, PAGE_ROWS = 1024, 1 << 18

PAGES = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, page int, pages int, width long, height long, samples int, bits int, compression int, predictor int, pixels binary, error string"


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, most: int = MOST_PAGE) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widened one code early; a clear starts each table."""
    acc = filled = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, filled
        acc, filled = acc << width | code, filled + width
        while filled >= 8:
            filled -= 8
            out.append(acc >> filled & 255)
        acc &= (1 << filled) - 1

    table = {bytes((i,)): i for i in range(256)}
    put(256, 9)
    new, width, w = 258, 9, b""
    for c in data:
        x = w + bytes((c,))
        if x in table:
            w = x
            continue
        put(table[w], width)
        table[x] = new
        new += 1
        if new == 4094:
            put(256, width)
            table, new, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif new >= 1 << width:
            width += 1
        w = bytes((c,))
    if w:
        put(table[w], width)
        new += 1
        if new >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if filled:
        put(0, 8 - filled)
    return bytes(out)


def lzw_decode(data: bytes, most: int = MOST_PAGE) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last, out = first[:], 9, b"", []
    acc = filled = size = 0
    for byte in data:
        acc, filled = (acc << 8 | byte) & 0xFFFFFFFF, filled + 8
        if filled < width:
            continue
        filled -= width
        code = acc >> filled & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = first[:], 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        size += len(entry)
        if size >= most:
            break
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, most)
    if not d.eof and len(out) < most:
        raise ValueError("deflate data ends early")
    return out


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: packbits_encode}
#: Each takes the most bytes that a chunk can have: what decodes to more is cut, not held.
DECODE = {NONE: lambda d, most: bytes(d[:most]), LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}
#: The most that one byte of each compression can decode to, by its format.
GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: int = 0) -> bytes:
    """A classic little-endian TIFF of 8-bit pages [height, width], or [height, width, samples]."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for p in pages:
        p = p.reshape(*p.shape[:2], -1)
        high, wide, samples = p.shape
        if tile:
            padded = np.zeros((-(-high // tile) * tile, -(-wide // tile) * tile, samples), np.uint8)
            padded[:high, :wide] = p
            chunks = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            chunks = [p[y : y + strip_rows] for y in range(0, high, strip_rows)]
        offsets, counts = [], []
        for c in chunks:
            if predictor == 2:
                c = np.concatenate([c[:, :1], np.diff(c, axis=1)], axis=1)
            raw = ENCODE[compression](c.tobytes())
            out += b"\0" * (len(out) % 2)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        tags = [(WIDTH, [wide]), (HEIGHT, [high]), (BITS, [8] * samples), (COMPRESSION, [compression]), (PHOTOMETRIC, [1 if samples < 3 else 2]), (SAMPLES, [samples]), (PREDICTOR, [predictor])]
        tags += [(TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)] if tile else [(OFFSETS, offsets), (ROWS, [strip_rows]), (COUNTS, counts)]
        entries = b""
        for tag, values in sorted(tags):
            own = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                out += b"\0" * (len(out) % 2)
                own, place = struct.pack("<I", len(out)), own
                out += place
            entries += struct.pack("<HHI", tag, 4, len(values)) + own
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each directory in the chain; a chain that comes back on itself ends."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    version = struct.unpack_from(order + "H", raw, 2)[0]
    if version not in (42, 43):
        raise ValueError(f"no TIFF version {version}")
    big = version == 43
    at, seen = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
        at += 8 if big else 2
        if n * (20 if big else 12) > len(raw) - at:
            raise ValueError(f"a directory of {n} entries in a file of {len(raw)} bytes")
        tags = {}
        for _ in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, at)
            inline = at + (12 if big else 8)
            if kind in FIELD:
                if count > len(raw):
                    raise ValueError(f"a field of {count} values in a file of {len(raw)} bytes")
                form = order + (f"{count}s" if kind == 2 else FIELD[kind] * count)
                where = inline if struct.calcsize(form) <= (8 if big else 4) else struct.unpack_from(order + ("Q" if big else "I"), raw, inline)[0]
                tags[tag] = struct.unpack_from(form, raw, where)
            at += 20 if big else 12
        yield order, tags
        at = struct.unpack_from(order + ("Q" if big else "I"), raw, at)[0]


def undo(c: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """c: [rows, columns, samples] of a chunk, as stored; predictor 3 has its bytes in planes."""
    if predictor == 2:
        return np.cumsum(c, axis=1, dtype=c.dtype)
    if predictor == 3:
        rows, columns, samples = c.shape
        size = c.dtype.itemsize
        flat = np.ascontiguousarray(c).view(np.uint8).reshape(rows, columns * samples * size)
        flat = np.cumsum(flat.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(np.dtype(f">f{size}")).reshape(rows, columns, samples).astype(c.dtype)
    return c


def page(raw: bytes, order: str, tags: dict[int, tuple]) -> tuple[np.ndarray, dict]:
    """Samples [height, width, samples] of one directory, and what they are."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    wide, high, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, kind, compression, predictor = one(BITS, 1), one(FORMAT, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if len(set(tags.get(BITS, (1,)))) > 1 or kind == 3 and bits < 32 or predictor == 3 and kind != 3:
        raise ValueError(f"no samples of {tags.get(BITS)} bits, format {kind}, predictor {predictor}")
    if bits not in (8, 16, 32, 64) or compression not in DECODE or predictor not in (1, 2, 3):
        raise ValueError(f"no samples of {bits} bits, compression {compression}, predictor {predictor}")
    dtype = np.dtype(f"{order}{'uif'[kind - 1] if kind <= 3 else 'u'}{bits // 8}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    per = samples // planes
    if TILE_OFFSETS in tags:
        ch, cw, offsets, counts = one(TILE_HEIGHT), one(TILE_WIDTH), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        ch, cw, offsets, counts = min(one(ROWS, high), high), wide, tags[OFFSETS], tags[COUNTS]
    if min(wide, high, cw, ch, samples, per) < 1 or samples % planes:
        raise ValueError(f"no page of {wide} by {high} samples in chunks of {cw} by {ch}")
    across, down = -(-wide // cw), -(-high // ch)
    size = high * wide * samples * dtype.itemsize
    # chunks are at least the page: more than the file can decode to is a lie
    if size > min(MOST_PAGE, GROWTH[compression] * (len(raw) + 1)) or len(offsets) != across * down * planes or len(counts) != len(offsets):
        raise ValueError(f"a page of {size} bytes in {len(offsets)} chunks and {len(raw)} bytes")
    out = np.zeros((planes, high, wide, per), dtype)
    for i, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, y, x = i // (across * down), i // across % down * ch, i % across * cw
        rows = ch if TILE_OFFSETS in tags else min(ch, high - y)
        data = DECODE[compression](raw[at : at + n], rows * cw * per * dtype.itemsize)
        c = np.frombuffer(data, dtype, rows * cw * per).reshape(rows, cw, per)
        out[plane, y : y + rows, x : x + cw] = undo(c, predictor, order)[: high - y, : wide - x]
    joined = np.concatenate(list(out), axis=2) if planes > 1 else out[0]
    return joined, {"width": wide, "height": high, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor}


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % LINE or (0 if text else LINE))


def encode(text: bytes, page_rows: int = PAGE_ROWS) -> bytes:
    """A text as TIFF pages 64 samples wide."""
    grid = np.frombuffer(payload(text), np.uint8).reshape(-1, LINE)
    return write([grid[y : y + page_rows] for y in range(0, len(grid), page_rows)])


def store(docs: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Rows (doc_id, n_bytes, media): each text of ``docs`` as a TIFF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in common.sized(texts, 8_000_000):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array([encode(t, page_rows) for t in texts[lo:hi]], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return common.mapped(rows, run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """One row per page of every TIFF in ``media`` (doc_id, n_bytes, media), pages in order."""
    names = [x.split()[0] for x in PAGES.split(", ")]

    def pages_of(raw: bytes) -> Iterator[tuple]:
        try:
            found = list(directories(raw))
            if not found:
                raise ValueError("no page")
            for i, (order, tags) in enumerate(found):
                pixels, what = page(raw, order, tags)
                yield (i, len(found), *what.values(), pixels.tobytes(), None)
        except Exception as e:  # noqa: BLE001  whatever a broken file does, it is its row's error
            yield (None,) * 9 + (f"{type(e).__name__}: {e}",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(n, t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)])
        for b in batches:
            rows, held = [], 0
            for key, n, media in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = media or b""
                for p in pages_of(raw):
                    rows.append((key, n, len(raw), hashlib.sha256(raw).hexdigest(), *p))
                    held += len(p[-2] or b"")
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return common.mapped(media.select("doc_id", "n_bytes", "media"), run, PAGES)


def features(data: np.ndarray) -> str:
    """What the samples look like: mean, deviation, and shares of eight ranges of values."""
    n = len(data)
    counts = np.bincount(data, minlength=256)
    values = np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = (int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    return f"mean={mean:.4f};std={spread:.4f};hist=" + ",".join(f"{x / n:.4f}" for x in counts.reshape(8, 32).sum(axis=1).tolist())


def digest(pages: DataFrame) -> DataFrame:
    """One row per document of ``read``'s rows, whose pages follow each other in order."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int, error string"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for b in batches:
            rows = []
            for key, n, size, sha, i, of, raw, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = [*(parts if i else []), raw or b""]
                if error is not None:
                    rows.append((key, n, None, None, None, size, sha, None, of, error))
                    parts = []
                elif i + 1 == of:
                    data = b"".join(parts)
                    rows.append((key, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-LINE:]), size, sha, features(np.frombuffer(data, np.uint8)) if data else None, of, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in schema.split(", ")])

    return common.mapped(pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "pages", "pixels", "error"), run, schema)
