"""Main text of web pages: page structure first, then runs of tokens that a host's pages repeat.

A page is walked once. Text in an article (``article``, ``main``, or their roles) is main text;
text in navigation, headers, footers, sidebars, forms, notices, adverts and comments, by element or
by its role or a whole class or id, is not, and neither are scripts, styles and hidden elements.
What lies outside an article and is marked as neither is open.

Open text is settled by the suffix array of its host. All blocks of a page outside its articles are
one stream of tokens, over the edges of blocks. The suffixes of a host's streams are sorted, and the
longest prefix that a suffix shares with one of another page comes from its neighbours in that order.
Tokens are boilerplate where a run of ``RUN`` of them is on ``PAGES`` distinct pages or more, or a run
of ``LONG`` on two. An open block loses the boilerplate within it, as far as that is ``RUN`` tokens
long, and goes as a whole if repeats, those over its edges included, cover all of it; a block of
fewer than ``RUN`` tokens goes if it is, as a whole, on ``PAGES`` pages. Unique runs stay.

The array is built without ever holding a host in one place:

* Suffixes are named by their first RUN tokens, and names are counted with partial sums. A name that is
  on one page only ends there: such a suffix shares less than RUN tokens with any other page.
* The others are cut at ``DEPTH`` tokens (a longer repeat is the union of those of its suffixes) and
  equal ones become one, which knows its least and its greatest page. So a notice on a third of all
  pages is a row for each of its tokens.
* These are sorted by (host, tokens) in ranges. A task compares neighbours; what it can't see beyond
  its range's ends is added from one row per range. Of suffixes of one and the same page that follow
  each other the common prefixes are passed on.

Every page takes part, those without an open block too: their menus and notices are what others of their
host are compared to, and each page's row says how much of it the array found. Equal streams of a host
go in as one; where those with boilerplate are too many to be sent to every task, texts are shuffled once.

Defined cases: null html is empty; a page without an article is all open text; unclosed and stray
tags end where HTML's parser would end them, as far as blocks matter; a null url has an empty host;
rows of the same host and html count as one page; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of a run, and distinct pages of a host that it is on from which it is boilerplate; tokens of
#: one that is so on two pages, and those to which suffixes are compared.
RUN, PAGES, LONG, DEPTH = 6, 3, 12, 24
MAIN, OPEN, OTHER = 0, 1, 2
#: In a wrapper by its class or a form: as OTHER, but an article in it is main text.
WRAPPED = 3

#: Fixed: HTML's elements by what they are to a reader.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title noembed noframes xmp".split())
#: Fixed: elements of other markup languages, which a slash in their tag ends.
FOREIGN = ("svg", "math")
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside button datalist dialog fieldset footer form head header label menu nav search select".split())
CLOSES_P = BLOCK - {"br", "body", "head", "html", "option", "optgroup", "caption", "legend"}
#: Fixed: words in a class, id or role that mark boilerplate, and roles of a main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
MAIN_MARKS = frozenset(("article", "main"))
#: Fixed: words beside a mark in names of boilerplate, and words of those that may wrap a whole page.
QUALIFIERS = frozenset("area bar block body bottom box btn button buttons count cta desktop fixed form global icon icons item items left link links list message mobile module nav page panel post posts primary right secondary section site slot small sticky text title top unit".split())
WRAPS = frozenset("container holder inner layout outer wrap wrapped wrapper".split())
#: Fixed: marks that make no main text of an article.
BESIDE = frozenset("ad ads advert adverts advertisement advertising comment comments cookie cookies disqus newsletter promo promoted promotion related replies reply respond sponsor sponsored".split())
#: Fixed: what an open head may hold.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARK = re.compile(r"[a-z0-9]+")


def marked(value: str) -> tuple[set[str], bool]:
    """(marks, whether it may wrap a page) of one class or id: a name has marks if it is nothing but
    marks, or marks and words that go with them; a mark in another slug says nothing."""
    parts = {w for w in MARK.findall(value) if w.isalpha()}
    marks = parts & MARKS
    return (marks, bool(parts & WRAPS)) if parts <= MARKS | QUALIFIERS | WRAPS else (set(), False)


def kind_of(name: str, attributes: str, within: int | None) -> int | None:
    """What an element makes of its text: MAIN, OPEN, OTHER or WRAPPED; None as what it is in."""
    if name in DROPPED:
        # an article's own header has its headline, and a form may hold the whole page
        return None if within == MAIN and name == "header" else WRAPPED if name == "form" and within != MAIN else OTHER
    marks: set[str] = set()
    wraps = True
    role = ""
    if attributes.strip(" /\n\t\r"):
        for key, *values in ATTRIBUTE.findall(attributes):
            value, key = "".join(values).lower(), key.lower()
            if key == "class" or key == "id" and name not in HEADINGS:  # a heading's id is a slug of its text
                for one in value.split():
                    own, wrap = marked(one)
                    marks |= own
                    wraps = wraps and (wrap or not own)
            elif key == "role":
                role = value
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return OTHER
    if name == "main" or role == "main" or (name == "article" or role == "article") and not marks & BESIDE:
        return MAIN
    if within == MAIN:
        marks.discard("header")
    if name not in ("html", "body") and (marks or role in MARKS):
        return WRAPPED if wraps and role not in MARKS else OTHER
    return None


def closed(attributes: str) -> bool:
    """Whether a tag ends its own element: a slash before the angle that is no part of a bare value."""
    return attributes.endswith("/") and not re.search(r"=\s*[^\s\"'>]+$", attributes)


def foreign_end(page: str, name: str, at: int) -> int:
    """Where an element of another markup language ends that began before ``at``: elements of its own name
    can be in it. An unclosed one ends with the page."""
    depth = 1
    for m in TAG.finditer(page, at):
        end, own, attributes = m.groups()[:3] if m[2] else m.groups()[3:]
        if own and own.lower() == name:
            depth += -1 if end else not closed(attributes)
            if not depth:
                return m.end()
    return len(page)


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of the page's blocks in order, white space made one, references decoded."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    now, at, n = OPEN, 0, len(page)

    def flush() -> None:
        nonlocal text
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, OTHER if now == WRAPPED else now))
            text = []

    def body() -> None:
        """End a head that is still open."""
        nonlocal now
        if stack and stack[-1][0] == "head":
            flush()
            now = stack.pop()[1]

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            if page[at:].strip():
                body()
            text.append(page[at:])
            break
        if m.start() > at:
            if not page[at : m.start()].isspace():
                body()
            text.append(page[at : m.start()])
        at = m.end()
        # a tag whose quote never ends ends at its angle
        end, name, attributes = m.groups()[:3] if m[2] else m.groups()[3:]
        if name is None:
            continue
        name = name.lower()
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if now != stack[i][1] or name in BLOCK:
                        flush()
                    now = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body", "nav", "aside", "footer", "table", "div", "section") and name in ("p", "b", "i", "em", "strong", "a", "span", "li"):
                    break  # a stray end of something small doesn't end what it is in
            continue
        if name not in HEAD:
            body()
        if name in RAW:
            if name not in FOREIGN:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            elif not closed(attributes):
                at = foreign_end(page, name, at)
            if name not in (*FOREIGN, "canvas"):
                flush()
            else:
                text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if name in CLOSES_P or name in ("p", "li"):
            # a new block ends an open paragraph, and a new item the item before it
            ends = ("p", "li") if name == "li" else ("p",)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    now = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        kind = OTHER if now == OTHER else kind_of(name, attributes, now)
        if kind is not None and kind != now:
            flush()
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            stack.append((name, now))
            now = now if kind is None else kind
    flush()
    return out


def token_hashes(parsed: list[tuple[str, int]]) -> np.ndarray:
    """The stream of a page's tokens outside its articles, as hashes."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(t) for text, k in parsed if k != MAIN for t in text.split(" ")), np.uint64)


def run_names(stream: np.ndarray, host: int) -> np.ndarray:
    """Name of the RUN tokens from each place on, in its host."""
    if len(stream) < RUN:
        return np.zeros(0, np.int64)
    out = np.full(len(stream) - RUN + 1, host & (2**64 - 1), np.uint64)
    for i in range(RUN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + stream[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def short_name(text: str, host: int) -> int:
    """Name of a whole block of fewer than RUN tokens, in its host."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(text, host & (2**64 - 1))).view(np.int64))


def main_text(parsed: list[tuple[str, int]], repeats: list[tuple[int, int]] = (), short: set[str] = frozenset()) -> str:
    """Blocks of the main text, and what is left of open ones without ``repeats`` (first token in the
    stream, tokens) and the ``short`` blocks that are repeated."""
    if not repeats and not short:
        return " ".join(t for t, k in parsed if k != OTHER)
    own = [t.split(" ") if k != MAIN else [] for t, k in parsed]
    ends = np.cumsum([len(ts) for ts in own])
    inner, covered = np.zeros(ends[-1], bool), np.zeros(ends[-1], bool)
    for at, n in repeats:
        covered[at : at + n] = True
        for k in range(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, at + n - 1, "right")) + 1):
            lo, hi = max(at, ends[k] - len(own[k])), min(at + n, ends[k])
            if hi - lo >= RUN:
                inner[lo:hi] = True
    out = []
    for (text, kind), ts, end in zip(parsed, own, ends.tolist(), strict=True):
        at = slice(end - len(ts), end)
        if kind == OPEN:
            if covered[at].all() or len(ts) < RUN and text in short:
                continue
            text = " ".join(t for t, c in zip(ts, inner[at].tolist(), strict=True) if not c)
        if kind != OTHER and text:
            out.append(text)
    return " ".join(out)


def boilerplate_tokens(parsed: list[tuple[str, int]], repeats: list[tuple[int, int]], short: set[str]) -> np.ndarray:
    """Of each token outside articles whether it is in one of ``repeats`` or in one of the ``short`` blocks."""
    outside = [(t, t.count(" ") + 1) for t, k in parsed if k != MAIN]
    covered = np.zeros(sum(n for _, n in outside), bool)
    for at, n in repeats:
        covered[at : at + n] = True
    at = 0
    for text, n in outside:
        covered[at : at + n] |= n < RUN and text in short
        at += n
    return covered


PARSED = "page_id long, url string, kinds array<int>, texts binary, stream binary, short array<long>, host long, page long, same long"


def parse(pages: DataFrame) -> DataFrame:
    """Each page with its blocks (kinds, and texts by lines, which no block has, packed), its stream outside articles and the names of its short blocks there.
    ``page`` names a host's distinct contents, ``same`` its distinct streams with their short blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in common.slices(b.column(2), common.BATCH_BYTES):
                kinds, packed, streams, short = [], [], [], []
                for page, h in zip(b.column(2)[lo:hi], b.column(3)[lo:hi].to_pylist(), strict=True):
                    got = blocks(page.as_py() or "")
                    kinds.append([k for _, k in got])
                    packed.append(zlib.compress("\n".join(t for t, _ in got).encode()))
                    streams.append(token_hashes(got).tobytes())
                    short.append(sorted({short_name(t, h) for t, k in got if k != MAIN and t.count(" ") < RUN - 1}))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(kinds, pa.list_(pa.int32())), pa.array(packed, pa.binary()), pa.array(streams, pa.binary()), pa.array(short, pa.list_(pa.int64())), b.column(3)[lo:hi], b.column(4)[lo:hi]],
                    ["page_id", "url", "kinds", "texts", "stream", "short", "host", "page"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host()).alias("host")).withColumn("page", F.xxhash64("host", "html"))
    return common.mapped(rows, run, PARSED.removesuffix(", same long")).withColumn("same", F.xxhash64("host", "stream", "short"))


def host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("")))


def names(streams: DataFrame, places: bool) -> DataFrame:
    """Rows (name, pages) of each stream, every name once; with ``places`` rows (name, same, at) of every place,
    -1 for short blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, own, at = [], [], []
            for s, n, h, raw, short in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                got = run_names(np.frombuffer(raw, np.uint64), h)
                own.append(np.concatenate([got, np.array(short, np.int64)]) if places else np.union1d(got, np.array(short, np.int64)))
                at.append(np.concatenate([np.arange(len(got)), np.full(len(short), -1)]))
                of.append(np.full(len(own[-1]), s if places else n))
            if not own:
                continue
            columns = [own, of, at] if places else [own, of]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], ["name", "same" if places else "pages", "at"][: len(columns)])

    return common.mapped(streams.select("same", "pages", "host", "stream", "short"), run, "name long, same long, at long" if places else "name long, pages long")


def suffixes(streams: DataFrame, named: DataFrame) -> DataFrame:
    """Rows (same, least, greatest, at, n, suffix, key) of the places of ``named`` (same, at, n): the host and the
    next DEPTH tokens, in 4 bytes each, and its hash."""
    mine = named.groupBy("same").agg(F.collect_list(F.struct("at", "n")).alias("places"))  # no more than a page's tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, least, greatest, h, raw, places in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                low = np.frombuffer(raw, np.uint64).astype(np.uint32).astype(">u4").tobytes()
                head = (h & (2**64 - 1)).to_bytes(8, "big")
                at = [x["at"] for x in places]
                longs = [pa.array(c, pa.int64()) for c in ([s] * len(at), [least] * len(at), [greatest] * len(at), at, [x["n"] for x in places])]
                yield pa.RecordBatch.from_arrays([*longs, pa.array([head + low[4 * i : 4 * (i + DEPTH)] for i in at], pa.binary())], ["same", "least", "greatest", "at", "n", "suffix"])

    met = streams.join(mine, "same").select("same", "least", "greatest", "host", "stream", "places")
    return common.mapped(met, run, "same long, least long, greatest long, at long, n long, suffix binary").withColumn("key", F.xxhash64("suffix"))


def common_prefix(a: bytes, b: bytes) -> int:
    """Tokens that two suffixes begin with together; none in different hosts."""
    if a[:8] != b[:8]:
        return 0
    n = next((i for i in range(8, min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    return (n - 8) // 4


def shared_ahead(prefix: list[int], pages: list[int | None]) -> tuple[list[int], list[int]]:
    """Of each suffix in order: tokens shared with the nearest suffix before it that is on another page,
    and with all before it up to the first one where these are on its own page alone, else -1. prefix:
    tokens shared with the suffix before; pages: its only page, None for several."""
    found, reach = [0] * len(pages), [-1] * len(pages)
    for i, page in enumerate(pages):
        if not i:
            reach[i] = DEPTH
        elif page is not None and page == pages[i - 1]:
            found[i] = min(prefix[i], found[i - 1])
            reach[i] = min(prefix[i], reach[i - 1])
        else:
            found[i] = prefix[i]
    return found, reach


_EDGE = "struct<first: binary, first_page: long, last: binary, last_page: long, left: int, left_reach: int, right: int, right_reach: int>"


def suffix_array(distinct: DataFrame) -> DataFrame:
    """Rows (key, shared) of distinct suffixes (key, suffix, least, greatest): the tokens that each begins
    with together with a suffix of another page of its host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, b""
        key, size, pages, prefix = [], [], [], []
        for b in batches:
            for k, suffix, least, greatest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = suffix if first is None else first
                key.append(k)
                size.append((len(suffix) - 8) // 4)
                pages.append(least if least == greatest else None)
                prefix.append(common_prefix(last, suffix))
                last = suffix
        if first is None:
            return
        left, left_reach = shared_ahead(prefix, pages)
        right, right_reach = (x[::-1] for x in shared_ahead([0, *prefix[:0:-1]], pages[::-1]))
        shared = [n if p is None else max(x, y) for n, p, x, y in zip(size, pages, left, right, strict=True)]
        edge = {"first": first, "first_page": pages[0], "last": last, "last_page": pages[-1], "left": left[-1], "left_reach": left_reach[-1], "right": right[0], "right_reach": right_reach[0]}
        step = 100_000
        for at in range(0, len(key), step):
            to = slice(at, at + step)
            n = len(key[to])
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[to], pa.int64()), "part": pa.array([part] * n, pa.int32()), "shared": pa.array(shared[to], pa.int32()), "left": pa.array(left_reach[to], pa.int32()), "right": pa.array(right_reach[to], pa.int32()), "edge": pa.array([None if at or i else edge for i in range(n)], _EDGES)})

    ranges = distinct.select("key", "suffix", "least", "greatest").repartitionByRange("suffix").sortWithinPartitions("suffix")
    ordered = common.stored(common.mapped(ranges, run, f"key long, part int, shared int, left int, right int, edge {_EDGE}"), "suffix_array")
    edges = ordered.where("edge is not null").select("part", "edge.*").orderBy("part").collect()  # one row for each range
    ahead, behind = {}, {}
    for before, own in zip([None, *edges[:-1]], edges, strict=False):
        n = common_prefix(before["last"], own["first"]) if before else 0
        if n and before["last_page"] is not None and before["last_page"] == own["first_page"]:
            n = min(n, max(before["left"], min(before["left_reach"], ahead[before["part"]])))
        ahead[own["part"]] = n
    for after, own in zip([None, *edges[:0:-1]], reversed(edges), strict=False):
        n = common_prefix(own["last"], after["first"]) if after else 0
        if n and after["first_page"] is not None and after["first_page"] == own["last_page"]:
            n = min(n, max(after["right"], min(after["right_reach"], behind[after["part"]])))
        behind[own["part"]] = n
    ends = distinct.sparkSession.createDataFrame([(p, ahead[p], behind[p]) for p in ahead], "part int, ahead int, behind int")
    met = ordered.join(F.broadcast(ends), "part")
    return met.select("key", F.greatest("shared", F.least("left", "ahead"), F.least("right", "behind")).alias("shared"))


_EDGES = pa.struct([("first", pa.binary()), ("first_page", pa.int64()), ("last", pa.binary()), ("last_page", pa.int64()), *[(x, pa.int32()) for x in ("left", "left_reach", "right", "right_reach")]])


def repeated(parsed: DataFrame) -> DataFrame:
    """Rows (same, repeats, short) of the streams that have boilerplate: its places as (at, n), and names of
    short blocks. Equal streams of a host are looked at once, and count for all of their pages."""
    counts = parsed.select("page", "same").distinct().groupBy("same").agg(F.count("*").alias("pages"), F.min("page").alias("least"), F.max("page").alias("greatest"))
    streams = common.stored(parsed.select("same", "host", "stream", "short").dropDuplicates(["same"]).join(counts, "same"), "page_streams")
    counted = names(streams, False).groupBy("name").agg(F.sum("pages").alias("n")).where("n > 1")
    named = common.stored(names(streams, True).join(counted, "name"), "repeated_names")
    places = common.stored(suffixes(streams, named.where("at >= 0").select("same", "at", "n")), "suffixes")
    distinct = places.groupBy("key").agg(F.min("suffix").alias("suffix"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    met = places.select("key", "same", "at", "n").join(suffix_array(distinct), "key")
    length = F.when(F.col("n") >= PAGES, F.greatest("shared", F.lit(RUN))).when(F.col("shared") >= LONG, F.col("shared"))
    long = met.select("same", F.struct("at", length.cast("long").alias("n")).alias("repeat"), F.lit(None).cast("long").alias("name")).where("repeat.n is not null")
    whole = named.where((F.col("at") < 0) & (F.col("n") >= PAGES)).select("same", F.lit(None).cast("struct<at: long, n: long>").alias("repeat"), "name")
    return long.unionAll(whole).groupBy("same").agg(F.collect_list("repeat").alias("repeats"), F.collect_list("name").alias("short"))


def boilerplate(parsed: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows (page, repeats, short) of the pages of ``hosts`` (host) that have boilerplate."""
    own = parsed.join(hosts, "host", "left_semi")
    return own.select("page", "same").distinct().join(repeated(own), "same").select("page", "repeats", "short")


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars, n_outside, n_repeated) of ``pages`` (page_id, url, html); the last are tokens
    outside articles, and those of them that are boilerplate by the array."""
    parsed = common.stored(parse(pages), "parsed_pages")
    found = common.stored(repeated(parsed), "stream_boilerplate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, outside, repeated = [], [], []
            for kinds, packed, repeats, short, h in zip(*(b.column(k).to_pylist() for k in range(2, 7)), strict=True):
                got = list(zip(zlib.decompress(packed).decode().split("\n"), kinds, strict=True)) if kinds else []
                known = set(short or ())
                places = [(x["at"], x["n"]) for x in repeats or ()]
                named = {t for t, k in got if known and k != MAIN and t.count(" ") < RUN - 1 and short_name(t, h) in known}
                covered = boilerplate_tokens(got, places, named)
                texts.append(main_text(got, places, named))
                outside.append(len(covered))
                repeated.append(int(covered.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(outside, pa.int64()), pa.array(repeated, pa.int64())], ["page_id", "url", "text", "n_outside", "n_repeated"])

    met = parsed.select("page_id", "url", "kinds", "texts", "host", "same").join(found, "same", "left").select("page_id", "url", "kinds", "texts", "repeats", "short", "host")
    out = common.mapped(met, run, "page_id long, url string, text string, n_outside long, n_repeated long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_outside", "n_repeated")
