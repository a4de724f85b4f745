"""Packing documents into as few sequences of a fixed token length as possible.

Documents are tokenized once into pieces (only a document longer than a sequence is cut). How
many pieces of each length exist decides the packing, so the driver plans on that histogram (as
many rows as a sequence has tokens, however large the corpus): best fit over lengths in falling
order gives patterns with multiplicities, then a swap-based local search moves, swaps one for one
and swaps two for one between underfull bins, all bins of two patterns at once, always raising the
sum of squared fill, until no exchange raises it or the lower bound ceil(ids / length) is met,
whatever the number of bins. What can be exchanged is looked up by sums and room, and patterns that most
bins have come first. Executors then look up each piece's place by its rank among the pieces of its length.

No window or group holds a hot length whole: pieces are dealt by ranges of (length, hash), so that a
length with a third of all pieces takes a third of the tasks. A task numbers its pieces of each
length, and a piece's rank adds the counts of its length in the tasks before; as these are ranges,
there are no more such counts than tasks and lengths together.

Defined cases: null text is empty (one piece with the end id); repeated doc_ids are packed as
separate rows; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A pattern: its (length, copies) in order.
Key = tuple[tuple[int, int], ...]

PLACED = PIECES + ", sequence_id long, offset long"


@dataclass
class Bins:
    """``times`` bins of one pattern: runs of (length, copies)."""

    times: int
    room: int
    runs: dict[int, int] = field(default_factory=dict)

    def split(self, times: int) -> Bins:
        self.times -= times
        return Bins(times, self.room, dict(self.runs))

    def put(self, length: int, copies: int) -> None:
        self.runs[length] = self.runs.get(length, 0) + copies
        if not self.runs[length]:
            del self.runs[length]
        self.room -= length * copies


def best_fit(counts: dict[int, int], cap: int) -> list[Bins]:
    """Best fit, longest first, over whole lengths at a time: a bin goes on taking a length while
    it has room, as it stays the tightest one."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def add(b: Bins) -> None:
        if b.room not in by_room:
            by_room[b.room] = []
            bisect.insort(rooms, b.room)
        by_room[b.room].append(b)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                fit = cap // length
                for times, copies in ((left // fit, fit), (1, left % fit)):
                    if times and copies:
                        add(b := Bins(times, cap))
                        take_out(by_room, rooms, b)
                        b.put(length, copies)
                        add(b)
                break
            b = by_room[rooms[i]][-1]
            take_out(by_room, rooms, b)
            fit = b.room // length
            times, copies = (min(b.times, left // fit), fit) if left >= fit else (1, left)
            if times < b.times:
                rest = b
                b = rest.split(times)
                add(rest)
            b.put(length, copies)
            left -= times * copies
            add(b)
    return [b for r in rooms for b in by_room[r]]


def take_out(by_room: dict[int, list[Bins]], rooms: list[int], b: Bins) -> None:
    by_room[b.room].remove(b)
    if not by_room[b.room]:
        del by_room[b.room]
        del rooms[bisect.bisect_left(rooms, b.room)]


def sets_of(b: Bins) -> list[tuple[int, ...]]:
    """What can leave a bin at once: one length or two."""
    own = sorted(b.runs)
    return [*((x,) for x in own), *((x, y) for i, x in enumerate(own) for y in own[i:] if x != y or b.runs[x] > 1)]


class Shelf:
    """Sets of patterns by a number, as heaps: the least entry of each number and the number in a range whose
    least entry gains most are looked up, not searched for. Entries of patterns that no bin has any more go
    when they come up."""

    def __init__(self, numbers: int, alive: list[int]):
        self._heaps: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(numbers)]
        self._least = np.full(numbers, NEVER, np.int64)
        self._alive = alive

    def add(self, number: int, entry: tuple[int, int, tuple[int, ...]]) -> None:
        heapq.heappush(self._heaps[number], entry)
        self._least[number] = self._heaps[number][0][0]

    def best(self, lo: int, base: int | np.ndarray, factor: np.ndarray, unlike: int) -> tuple[int, int, tuple[int, int, tuple[int, ...]]] | None:
        """(gain, number, entry) of the most gain, if any: of the numbers from ``lo`` on, ``base`` less the least entry
        times ``factor``; not of pattern ``unlike``, if a single bin has it."""
        least = self._least[lo : lo + len(factor)]
        gains = (base - least) * factor
        others: dict[int, tuple[int, int, tuple[int, ...]]] = {}
        while True:
            i = int(gains.argmax())
            if gains[i] <= 0:
                return None
            heap, floor = self._heaps[lo + i], base if isinstance(base, int) else int(base[i])
            if i in others:
                return int(gains[i]), lo + i, others[i]
            while heap and not self._alive[heap[0][1]]:
                heapq.heappop(heap)
            now = heap[0][0] if heap else NEVER
            if now != least[i]:
                least[i] = now
                gains[i] = (floor - now) * factor[i]
            elif heap[0][1] != unlike or self._alive[unlike] > 1:
                return int(gains[i]), lo + i, heap[0]
            else:
                other = min((x for x in heap if x[1] != unlike and self._alive[x[1]]), default=None)
                gains[i] = (floor - other[0]) * factor[i] if other else 0
                if other:
                    others[i] = other


NEVER = 1 << 40


class Open:
    """Underfull bins by pattern, with what can leave them and what they can take, each on shelves: sets that
    can leave by their sum, with the emptiest pattern first; sets that can be given back by their sum and
    the room of their pattern, which is what may come in for them, with the least sum first."""

    def __init__(self, cap: int) -> None:
        self.cap, self.bins, self.times, self.number = cap, [], [], {}
        self._changed: list[tuple[int, int]] = []
        self._upto = np.arange(1, cap + 1)
        self._leave = {n: Shelf(cap + 1, self.times) for n in (1, 2)}
        self._enter = {n: Shelf(2 * cap + 1, self.times) for n in (1, 2)}  # 1: nothing or one comes back

    def add(self, b: Bins) -> None:
        key = key_of(b)
        k = self.number.get(key)
        if k is not None:
            if self.times[k] == 1:
                heapq.heappush(self._changed, (-1 - b.times, k))  # it can now be exchanged with its like
            self.times[k] += b.times
            return
        k = self.number[key] = len(self.bins)
        self.bins.append(b)
        self.times.append(b.times)
        self._enter[1].add(b.room, (0, k, ()))
        for one in sets_of(b):
            total = sum(one)
            self._leave[len(one)].add(total, (-b.room, k, one))
            self._enter[len(one)].add(total + b.room, (total, k, one))
        heapq.heappush(self._changed, (-b.times, k))

    def take(self, k: int, times: int) -> Bins:
        self.times[k] -= times
        if not self.times[k]:
            del self.number[key_of(self.bins[k])]
        return Bins(times, self.bins[k].room, dict(self.bins[k].runs))

    def compacted(self) -> Open:
        """Without patterns that no bin has."""
        new, waiting = Open(self.cap), {k for _, k in self._changed}
        settled = set()
        for k, b in enumerate(self.bins):
            if self.times[k]:
                if k not in waiting:
                    settled.add(len(new.bins))
                b.times = self.times[k]
                new.add(b)
        new._changed = [one for one in new._changed if one[1] not in settled]
        heapq.heapify(new._changed)
        return new

    def exchange(self) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """(donor, receiver, lengths that leave the donor, lengths that leave the receiver) of an exchange that
        raises the sum of squared fill: of the pattern of most bins that something changed for, with any other,
        the one that raises it most. None if there is no such exchange at all."""
        while self._changed:
            k = self._changed[0][1]
            found = self.times[k] and (self._given(k) or self._taken(k))
            if found:
                return found
            heapq.heappop(self._changed)
        return None

    def _given(self, a: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """The best exchange with ``a`` as the donor. What comes in, ``out``, fills a receiver up to its
        number on the shelf; that the squares rise means it ends fuller than ``a`` was."""
        best, most = None, 0
        room = self.bins[a].room
        for out in sets_of(self.bins[a]):
            total = sum(out)
            for n in (1, 2) if len(out) == 1 else (1,):
                met = self._enter[n].best(total, total, self._upto[room - 1 :: -1], a)
                if met and met[0] > most:
                    most, _, (_, b, lengths) = met
                    best = (a, b, out, lengths)
        return best

    def _taken(self, b: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """The same with ``b`` as the receiver."""
        best, most = None, 0
        room = self.bins[b].room
        for lengths in [(), *sets_of(self.bins[b])]:
            back = sum(lengths)
            # of the donors of what leaves, by its sum, one has to have more room than is left to b
            for n in (1, 2) if len(lengths) < 2 else (1,):
                met = self._leave[n].best(back + 1, self._upto[:room] - room, self._upto[:room], b)
                if met and met[0] > most:
                    most, _, (_, a, out) = met
                    best = (a, b, out, lengths)
        return best


#: Exchanges after which a row of them that comes again is looked for.
CYCLE = 256


def key_of(b: Bins) -> Key:
    return tuple(sorted(b.runs.items()))


class Search:
    """Bins, and exchanges among them that raise the sum of squared fill, from the most frequent patterns on."""

    def __init__(self, bins: list[Bins], cap: int):
        self.cap, self.n, self.open = cap, sum(b.times for b in bins), Open(cap)
        self.least = -(-sum((cap - b.room) * b.times for b in bins) // cap)
        self.full: dict[Key, Bins] = {}
        self.grain = 1
        self._few: dict[Key, Bins] = {}
        self._steps: list[tuple] = []
        self.refine(max((b.times for b in bins), default=1), [Bins(b.times, b.room, dict(b.runs)) for b in bins])

    def refine(self, grain: int, more: list[Bins] | None = None) -> None:
        """From now on take patterns of ``grain`` bins or more; the others wait."""
        self.grain, waiting, self._few = grain, list(self._few.values()), {}
        for b in (more or []) + waiting:
            self.put(b)

    def put(self, b: Bins) -> None:
        """Bins that were changed; those that emptied are gone."""
        if not b.runs:
            self.n -= b.times
        elif not b.room:
            same = self.full.setdefault(key_of(b), b)
            if same is not b:
                same.times += b.times
        else:
            few = self._few.pop(key_of(b), None)
            if few:
                b.times += few.times
            if b.times >= self.grain or key_of(b) in self.open.number:
                self.open.add(b)
            else:
                self._few[key_of(b)] = b

    def left(self) -> list[Bins]:
        return list(self.full.values()) + list(self._few.values()) + [Bins(t, b.room, b.runs) for b, t in zip(self.open.bins, self.open.times, strict=True) if t]

    def step(self) -> bool:
        """An exchange of as many bins as both patterns have; False if there is none."""
        found = self.open.exchange()
        if not found:
            return False
        k, to, out, back = found
        times = self.open.times[k] // 2 if to == k else min(self.open.times[k], self.open.times[to])
        a, b = self.open.take(k, times), self.open.take(to, times)
        before = (key_of(a), key_of(b))
        for lengths, giver, taker in ((out, a, b), (back, b, a)):
            for x in lengths:
                giver.put(x, -1)
                taker.put(x, 1)
        self._steps.append((times, before, (key_of(a), key_of(b))))
        for got in (k, to):  # what is left of a pattern may be too little now
            if 0 < self.open.times[got] < self.grain:
                self.put(self.open.take(got, self.open.times[got]))
        self.put(a)
        self.put(b)
        if len(self._steps) == CYCLE:
            self.leap()
            self._steps.clear()
        if len(self.open.bins) > 4096 + 4 * len(self.open.number):
            self.open = self.open.compacted()
        return True

    def leap(self) -> None:
        """If the last exchanges were a few that come again and again, as where a single bin takes from one
        bin of a frequent pattern after the other, make them as often as there are bins for, at once."""
        steps = self._steps
        period = next((p for p in range(1, len(steps) // 2 + 1) if steps[-p:] == steps[-2 * p : -p]), None)
        if not period:
            return
        change: Counter[Key] = Counter()
        used: Counter[Key] = Counter()
        for times, before, after in steps[-period:]:
            for key in before:
                change[key] -= times
                used[key] += times
            for key in after:
                change[key] += times
        have = {key: self.open.times[self.open.number[key]] if key in self.open.number else 0 for key, d in change.items() if d < 0}
        rounds = min(((have[key] - used[key]) // -change[key] for key in have), default=0)
        if rounds < 1:
            return
        for key, d in change.items():
            if d < 0:
                self.open.take(self.open.number[key], -d * rounds)
        for key, d in change.items():
            if d > 0:
                self.put(Bins(d * rounds, self.cap - sum(length * copies for length, copies in key), dict(key)))


def local_search(bins: list[Bins], cap: int) -> list[Bins]:
    """Raise the sum of squared fill by exchanges, until bins reach their lower bound or no exchange raises it,
    however many bins there are. As many bins as two patterns both have are exchanged at once, rows of exchanges
    that come again are made at once too, and what is to be exchanged is looked up, so that the work depends on
    patterns, not on how many bins have them. For this the most frequent patterns have to come first: with the
    emptiest first, one bin goes through all patterns before the next one does the same."""
    if sum(b.times for b in bins) <= -(-sum((cap - b.room) * b.times for b in bins) // cap):
        return bins
    search = Search(bins, cap)
    while True:
        while search.n > search.least and search.step():
            pass
        if search.n <= search.least or search.grain == 1:
            return search.left()
        search.refine(max(search.grain // 4, 1))


def plan(counts: dict[int, int], cap: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in each, first offset), by length and rank:
    rank r of a length is in sequence ``first + (r - rank) // copies``. Their number depends on
    ``cap``, not on how many pieces there are."""
    next_rank, out, seq = dict.fromkeys(counts, 0), [], 0
    for b in local_search(best_fit(counts, cap), cap):
        at = 0
        for length, copies in b.runs.items():
            out.append((length, next_rank[length], seq, copies, at))
            next_rank[length] += copies * b.times
            at += length * copies
        seq += b.times
    assert next_rank == counts, "the plan must place every piece"
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str | None = None, cap: int = 4096) -> DataFrame:
    """Pieces of every document: ids with the end id, cut only where longer than ``cap``."""
    path = path or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(path)
        for b in batches:
            for lo, hi in common.slices(b.column(1), tokens.TEXT_BYTES):
                ids, bounds = tok.documents(b.column(1)[lo:hi])
                raw = memoryview(ids.astype("<u4").tobytes())
                n = np.diff(bounds)
                parts = -(-n // cap)
                doc = np.repeat(np.arange(hi - lo), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * cap
                length = np.minimum(cap, n[doc] - start)
                first = (4 * (bounds[doc] + start)).tolist()
                crc = [zlib.crc32(raw[x : x + 4 * y]) for x, y in zip(first, length.tolist(), strict=True)]
                keys = b.column(0)[lo:hi].take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return common.mapped(rows, cut, PIECES)


def pack(docs: DataFrame, path: str | None = None, cap: int = 4096) -> DataFrame:
    """Each piece with its sequence and its offset there."""
    cut = common.stored(pieces(docs, path, cap), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most cap rows
    steps = plan(counts, cap)
    shift = np.int64(2**48)
    firsts = steps[:, 0] * shift + steps[:, 1]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece's number among its task's pieces of its length; they come in order of length."""
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(3).to_numpy()
            first = np.flatnonzero(np.diff(length, prepend=length[0] - 1))
            own = np.arange(len(length)) - np.repeat(first, np.diff(np.append(first, len(length))))
            if length[0] == last:
                own[: first[1] if len(first) > 1 else len(own)] += n
            last, n = length[-1], int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(own), pa.int32()), pa.array(own)], [*b.schema.names, "part", "number"])

    order = [F.col("length"), F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("doc_id"), F.col("piece")]
    ranges = cut.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = common.stored(common.mapped(ranges, number, PIECES + ", part int, number long"), "numbered_pieces")
    before: dict[tuple[int, int], int] = {}
    sofar: dict[int, int] = {}
    for r in dealt.groupBy("part", "length").count().orderBy("part", "length").collect():  # at most tasks and lengths together
        before[r["part"], r["length"]] = sofar.get(r["length"], 0)
        sofar[r["length"]] = before[r["part"], r["length"]] + r["count"]
    keys = np.array([p << 32 | n for p, n in before], np.int64)
    ahead = np.array(list(before.values()), np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(3).to_numpy()
            rank = b.column(6).to_numpy() + ahead[np.searchsorted(keys, b.column(5).to_numpy().astype(np.int64) << 32 | length)]
            _, first, seq, copies, at = steps[np.searchsorted(firsts, length * shift + rank, "right") - 1].T
            n = rank - first
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq + n // copies), pa.array(at + n % copies * length)], [*b.schema.names[:5], "sequence_id", "offset"])

    return common.mapped(dealt, place, PLACED)
