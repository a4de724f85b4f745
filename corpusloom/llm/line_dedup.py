"""Line deduplication across documents by a deletion-neighbourhood join. DataFrame functions only.

Lines are the text between line feeds; a line's words are what spaces, tabs, carriage returns and
form feeds separate. In the order of (doc_id, line number) a line is dropped if an earlier line has
the same words, or if both have ``MIN_WORDS`` words or more and one word inserted, removed or
replaced makes them equal. The earliest line of such a family stays; lines without words are no
lines for this and stay.

How the join finds the second kind without pairs and in linear space:

* A deletion variant of a line is the line without its i-th word, and, for lines one word shorter,
  the line as it is with a gap at i. Its hashed key holds i, the count of words, the hash of the
  words before i and the hash of those after. Lines with equal variants differ at i only, so all
  lines that share a variant are one edit apart from each other, and each needs a link to the
  earliest of them alone.
* Prefix and suffix hashes are running XORs of hashes of (word, place), so a line's variants cost
  as much as its words.
* Two lines an edit apart share their first or last half. Only lines that share a half with another
  distinct line emit variants, and only at places in the other half.
* The edit distance of every line and the earliest of each of its groups is verified on the words. Lines
  that share a 64-bit key by chance fail this, whoever is earliest; the lines of such keys, a handful in
  10^12, go through the join again by keys of 128 bits, so that no chance meeting hides a neighbour.
* Equal lines are equal in two 64-bit hashes of their words: of 10^13 lines, two others meet in both with
  a chance below 10^-12.

Only keys are shuffled until the last join, which takes each document's dropped line numbers to its
text. A line of very many documents meets itself in partial minima and in a join that can be split.

Defined cases: null text stays null; blank lines stay; rows of the same doc_id and the same text
count as one document, and of one doc_id and different texts as documents in the order of a hash;
null doc_ids come first; an empty table gives no rows; ``clean`` keeps all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: One edit in five words is a similarity of 0.8; the bound is one edit for longer lines too.
MIN_WORDS = 5
#: Of a variant's key; tests take fewer, so that keys meet by chance.
KEY_BITS = 64
#: Rows of a checked broadcast, or items of the lists in them, of some forty bytes each: beyond, the same join shuffles.
BROADCAST_ROWS = 1_000_000
_BLANK = " \t\r\f"
_POS = ("doc_id", "th", "line")


def words(line: Column) -> Column:
    for blank in _BLANK[1:]:
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")


def hashed_lines(docs: DataFrame) -> DataFrame:
    """Each line with words: its place, count of words, two hashes, and the keys of its halves, for
    partners of as many words (class n) and of one less (class n - 1)."""
    lines = numbered(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line", "s")).where(F.btrim("s", F.lit(_BLANK)) != "")
    lines = lines.select(*_POS, words(F.col("s")).alias("w")).withColumn("n", F.size("w"))

    def halves(m: Column) -> list[Column]:
        left = F.floor(m / 2).cast("int")
        right = m - left
        return [F.xxhash64(m, F.lit(0), F.slice("w", F.lit(1), left)), F.xxhash64(m, F.lit(1), F.slice("w", F.col("n") - right + 1, right))]

    n = F.col("n")
    keys = [F.when(n >= MIN_WORDS, k) for k in halves(n)] + [F.when(n > MIN_WORDS, k) for k in halves(n - 1)]
    return lines.select(*_POS, "n", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(7), "w").alias("h2"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if a count of its rows allows; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def repeated(lines: DataFrame) -> DataFrame:
    """Places of lines whose words an earlier line has."""
    pos = F.struct(*_POS)
    again = common.stored(lines.groupBy("h1", "h2").agg(F.min(pos).alias("kept"), F.count("*").alias("c")).where("c > 1").drop("c"), "repeated_words")
    return lines.join(again, ["h1", "h2"]).where(pos != F.col("kept")).select(*_POS)


def bound(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(h: Column, steps: tuple[int, ...] = (8, 64)) -> Column:
    """XORs of the first 0, 1, ... n of ``h``: within steps of so many, then over these in turn, so that
    long lines stay near linear and nothing is appended to."""
    def scan(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(xs)), lambda i: F.aggregate(F.slice(xs, F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x)))

    if not steps:
        return scan(h)

    def joined(parts: Column) -> Column:
        def over(base: Column) -> Column:
            inner = F.zip_with(parts, F.slice(base, F.lit(1), F.size(parts)), lambda s, b: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda v: v.bitwiseXOR(b)))
            return F.concat(F.flatten(inner), F.array(F.element_at(base, -1)))

        return bound(running(F.transform(parts, lambda s: F.element_at(s, -1)), steps[1:]), over)

    cuts = F.sequence(F.lit(0), F.floor((F.size(h) - 1) / steps[0]).cast("int"))
    return bound(h, lambda xs: bound(F.transform(cuts, lambda k: scan(F.slice(xs, k * steps[0] + 1, F.lit(steps[0])))), joined))


def candidates(docs: DataFrame, lines: DataFrame, again: DataFrame) -> DataFrame:
    """Lines, less those of ``again``, that share a half with other words: place, n, w, the ``halves``
    shared (numbers as in hashed_lines), and running hashes of the words before (p) and after (q)."""
    spread = lines.where(F.col("n") >= MIN_WORDS).select(*_POS, "h1", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("half", "k")).where("k is not null")
    shared = common.stored(spread.groupBy("k").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("k"), "line_halves")
    few = spread.join(small(shared), "k", "left_semi").groupBy(*_POS).agg(F.collect_set("half").alias("halves"))
    same = [few[c].eqNullSafe(again[c]) for c in _POS]
    few, (n,) = common.stored_counted(few.join(again, same, "left_anti"), "near_lines")
    by_doc = few.groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "halves")).alias("near"))
    by_doc = F.broadcast(by_doc) if n <= BROADCAST_ROWS else by_doc  # so many lines, in however many documents
    texts = numbered(docs)
    met = texts.join(by_doc.withColumnsRenamed({"doc_id": "d2", "th": "t2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))).select("doc_id", "th", F.split("text", "\n").alias("all"), "near")
    met = met.select("doc_id", "th", F.explode(F.transform("near", lambda x: F.struct(x["line"].alias("line"), x["halves"].alias("halves"), F.get("all", x["line"]).alias("s")))).alias("x"))
    met = met.select("doc_id", "th", "x.line", "x.halves", words(F.col("x.s")).alias("w")).withColumn("n", F.size("w")).dropDuplicates([*_POS])
    n = F.col("n")
    return met.withColumns({"p": running(F.transform("w", lambda x, j: F.xxhash64(x, j))), "q": running(F.transform("w", lambda x, j: F.xxhash64(x, n - j)))})


def variants(lines: DataFrame, wide: bool = False) -> DataFrame:
    """Rows (place, v): hashed deletion variants of stored candidate lines; ``wide`` adds c, a second
    hash."""
    n = F.col("n")

    def key(*parts: Column) -> Column:
        v = F.xxhash64(*parts) if KEY_BITS == 64 else F.xxhash64(*parts).bitwiseAND(F.lit((1 << KEY_BITS) - 1))
        return F.struct(v.alias("v"), F.xxhash64(F.lit(7), *parts).alias("c")) if wide else v

    def at(lo: Column, end: Column, gap: bool) -> Column:
        """Keys of variants at places lo .. end - 1."""
        count = F.greatest(end - lo, F.lit(0))
        both = F.arrays_zip(F.slice("p", lo + 1, count).alias("p"), F.slice("q", lo + (1 if gap else 2), count).alias("q"))
        total = F.element_at("q", -1)
        return F.transform(both, lambda x, i: key(lo + i, n - (0 if gap else 1), x["p"], x["q"].bitwiseXOR(total)))

    def of(m: Column, half: int, shorter: bool) -> Column:
        left = F.floor(m / 2).cast("int")
        lo, end = (left, n) if half == 0 else (F.lit(0), n - (m - left))
        return at(lo, end, False) if shorter else F.concat(at(lo, end, False), at(lo, end + 1, True))

    none = F.array().cast("array<struct<v: bigint, c: bigint>>" if wide else "array<long>")
    parts = [F.when(F.array_contains("halves", i), of(n if i < 2 else n - 1, i % 2, i >= 2)).otherwise(none) for i in range(4)]
    if wide:
        return lines.select(*_POS, F.explode(F.concat(*parts)).alias("x")).select(*_POS, "x.v", "x.c").distinct()
    return lines.select(*_POS, F.explode(F.array_distinct(F.concat(*parts))).alias("v"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words, not equal, are one edit apart."""
    p = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    rest = lambda w, k: F.slice(w, p + k, F.greatest(F.size(w), F.lit(1)))
    d = F.size(a) - F.size(b)
    return F.when(d == 0, rest(a, 1) == rest(b, 1)).when(d == 1, rest(a, 1) == rest(b, 0)).when(d == -1, rest(a, 0) == rest(b, 1)).otherwise(False)


def near(lines: DataFrame, wide: bool = False) -> DataFrame:
    """Places of candidate lines that have an earlier one an edit apart."""
    pos, key = F.struct(*_POS), ["v", "c"] if wide else ["v"]
    v = common.stored(variants(lines, wide), "variants")
    groups = v.groupBy(*key).agg(F.min(pos).alias("kept"), F.max(pos).alias("last")).where("kept <> last").drop("last")
    pairs = v.join(groups, key).select(pos.alias("own"), "v", "kept").where("own <> kept")
    own = lines.select(pos.alias("own"), "w")
    both = pairs.join(own, "own").withColumnRenamed("w", "w1").join(own.withColumnsRenamed({"own": "kept", "w": "w2"}), "kept")
    seen = common.stored(both.select("own", "v", one_edit(F.col("w1"), F.col("w2")).alias("near")), "verified")
    found = seen.where("near").select("own.*").distinct()
    chance = seen.where("not near").select("v").distinct()
    if wide or chance.isEmpty():
        return found
    again = v.join(chance, "v", "left_semi").select(*_POS).distinct().withColumnsRenamed({c: f"_{c}" for c in _POS})
    same = [lines[c].eqNullSafe(again[f"_{c}"]) for c in _POS]
    return found.unionAll(near(common.stored(lines.join(again, same, "left_semi"), "met_by_chance"), True)).distinct()


def dropped(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, th, exact, near): sorted numbers of a document's dropped lines of each kind."""
    lines = common.stored(hashed_lines(docs), "hashed_lines")
    again = common.stored(repeated(lines), "repeated_lines")
    some = common.stored(candidates(docs, lines, again), "candidate_lines")
    gone = again.withColumn("same", F.lit(True)).unionAll(near(some).select(*_POS, F.lit(False)))
    sets = gone.groupBy("doc_id", "th").agg(F.collect_set(F.when(F.col("same"), F.col("line"))).alias("exact"), F.collect_set(F.when(~F.col("same"), F.col("line"))).alias("near"))
    return sets.select("doc_id", "th", F.array_sort("exact").alias("exact"), F.array_sort("near").alias("near"))


def without(text: Column, lines: Column) -> Column:
    """``text`` without the lines of the given sorted numbers, in one walk over both."""
    all_ = F.split(text, "\n")
    marks = F.transform(lines, lambda x, k: F.concat(F.repeat(F.lit("1"), x - F.coalesce(F.get(lines, k - 1), F.lit(-1)) - 1), F.lit("0")))
    mask = F.concat(F.array_join(marks, ""), F.repeat(F.lit("1"), F.size(all_) - F.element_at(lines, -1) - 1))
    kept = F.zip_with(all_, F.split(mask, ""), lambda s, m: F.when(m == "1", s))
    return F.when(F.size(lines) == 0, text).otherwise(F.array_join(F.filter(kept, lambda s: s.isNotNull()), "\n"))


def clean(docs: DataFrame, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``text`` without its dropped lines; ``counts`` names two more columns, how many
    equal an earlier line and how many are an edit away from one."""
    own = "_gone"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    gone = dropped(docs).withColumnsRenamed({"doc_id": f"{own}d", "th": f"{own}t", "exact": f"{own}x", "near": f"{own}n"})
    met = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[f"{own}d"]) & (F.xxhash64(docs["text"]) == gone[f"{own}t"]), "left")
    none = F.array().cast("array<int>")
    met = met.withColumns({f"{own}x": F.coalesce(f"{own}x", none), f"{own}n": F.coalesce(f"{own}n", none)})
    met = met.withColumn(f"{own}a", F.array_sort(F.concat(f"{own}x", f"{own}n")))
    met = met.withColumn("text", without(F.col("text"), F.col(f"{own}a")))
    sizes = [F.size(f"{own}{k}").cast("long").alias(c) for k, c in zip("xn", counts or (), strict=False)]
    return met.select(*docs.columns, *sizes)


#: The same result in DuckDB: every variant of every line is built and compared as a list of words.
ORACLE_SQL = r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS line, regexp_extract_all(ls[i], '[^ \t\r\f]+') AS w FROM s, unnest(range(1, len(ls) + 1)) AS t(i)),
p AS (SELECT *, min((doc_id, line)) OVER (PARTITION BY w) AS kept FROM l WHERE len(w) > 0),
f AS (SELECT doc_id, line, w FROM p WHERE (doc_id, line) = kept AND len(w) >= 5),
v AS (SELECT doc_id, line, i, w[:i] || w[i + 2:] AS rest, false AS gap FROM f, unnest(range(0, len(w))) AS t(i)
      UNION ALL SELECT doc_id, line, i, w, true FROM f, unnest(range(0, len(w) + 1)) AS t(i)),
g AS (SELECT doc_id, line, min((doc_id, line)) OVER (PARTITION BY i, rest) AS kept FROM v),
nd AS (SELECT DISTINCT doc_id, line FROM g WHERE (doc_id, line) <> kept),
gone AS (SELECT doc_id, line, 1 AS same FROM p WHERE (doc_id, line) <> kept UNION ALL SELECT doc_id, line, 0 FROM nd),
a AS (SELECT doc_id, list(line) AS lines, count(*) FILTER (WHERE same = 1) AS n_exact, count(*) FILTER (WHERE same = 0) AS n_near FROM gone GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n_exact, 0) AS BIGINT) AS n_exact, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
       CASE WHEN a.doc_id IS NULL THEN text ELSE array_to_string(list_filter(list_transform(ls, lambda x, i: CASE WHEN list_contains(lines, i - 1) THEN NULL ELSE x END), lambda x: x IS NOT NULL), chr(10)) END AS text
FROM s LEFT JOIN a ON s.doc_id = a.doc_id
"""
