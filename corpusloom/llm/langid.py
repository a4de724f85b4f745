"""Language identification of whole, perhaps mixed, texts.

A word's letters fall in script ranges, which leave only the languages seen in that script as
candidates. A trigram letter model of each candidate gives the word a log-likelihood, and Viterbi
over the words of a text, with a penalty for each switch of language, labels spans. The text's
language is the one that labels most of its letters, its score that share of all its letters.

Most texts have one language. Viterbi's answer is a single span if no stretch of words gains more
than the penalty by any other language, nor a first and a last stretch together, as a path that
leaves the best language altogether has one switch less than it has stretches. Running sums show
both at once; only other texts go through the word-by-word walk, many of them side by side. The answer
is the same.

The model is fitted on ``SAMPLE`` labelled documents at most, those whose hashed doc_id is least;
counts are gathered as hashed tables of fixed size, so neither texts nor what grows with the corpus
comes to the driver. Prediction needs no shuffle.

A language of which none of the ``SAMPLE`` documents is can't be predicted.

Defined cases: null text, or text without a letter, gives ``und`` with score 0; so does everything
if nothing could be learned; a null doc_id is not held out and not learned from; words of a script
that no learned language uses are in no span and count for none, but their letters lower the score;
a text of only such words gives ``und`` with score 0; repeated rows are judged alike; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents that a model is fitted on at most.
SAMPLE = 4000
#: Share of its letters that a text's language must have for the text to be accepted: texts in several
#: languages are no junk.
LEAST = 0.3
#: Cost of a switch of language, in nats.
SWITCH = 12.0
#: Share of a language's words in a script from which the script has it as a candidate.
SCRIPT_SHARE = 0.01
#: Of a word in a language that is no candidate.
FAR = -60.0
SMOOTH, LETTERS = 0.05, 64
H3, H2 = 1 << 17, 1 << 15

#: Fixed: first code points of ranges of letters, and the script of each range.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B80, 0x0C00, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00)
SCRIPT_NAMES = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Tamil", "Telugu", "Thai", "Lao", "Georgian", "Hangul", "Ethiopic", "Latin", "Greek", "other", "Hiragana", "Katakana", "other", "Hangul", "Han", "other", "Hangul", "other", "Han", "other")
_SCRIPTS = sorted(set(SCRIPT_NAMES))
_SCRIPT_OF = np.array([_SCRIPTS.index(n) for n in SCRIPT_NAMES])


def held_out() -> F.Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Letters:
    """Distinct words as arrays: hashed trigrams and their leading bigrams, by word."""

    def __init__(self, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = "  " + "  ".join(words) + "  "
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        # a word of n letters has n + 1 trigrams, the first over two spaces, the last with one
        self.first = np.concatenate([[0], np.cumsum(size[:-1] + 1)]) if len(words) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(size[:-1] + 2)]) if len(words) else np.zeros(0, np.int64)
        n = size + 1
        at = np.repeat(starts - self.first, n) + np.arange(int(n.sum()))
        self.h2 = (c[at] * 40503 + c[at + 1] * 7919) % H2
        self.h3 = (c[at] * 1000003 + c[at + 1] * 40503 + c[at + 2] * 7919) % H3
        self.script = _SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, c[starts + 2], "right") - 1] if len(words) else np.zeros(0, np.int64)
        self.trigrams = n


@dataclass
class Model:
    langs: list[str]
    tri: np.ndarray  # [H3, languages]: counts
    bi: np.ndarray  # [H2, languages]
    candidate: np.ndarray  # [scripts, languages]

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each distinct word in each language; not a number for words that are in no
        script of a learned language."""
        x = Letters(words)
        each = np.log(self.tri[x.h3] + np.float32(SMOOTH)) - np.log(self.bi[x.h2] + np.float32(SMOOTH * LETTERS))
        out = np.add.reduceat(each, x.first, axis=0, dtype=np.float64)
        allowed = self.candidate[x.script]
        none = ~allowed.any(axis=1)
        out[~allowed] = FAR
        out[none] = np.nan
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the languages in ``docs`` (doc_id, text, lang), from those not held out."""
    labelled = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = WORD.findall((text.as_py() or "").lower())
                if words:
                    x = Letters(words)
                    t = sums.setdefault(lang, [np.zeros(H3, np.int64), np.zeros(H2, np.int64), np.zeros(len(_SCRIPTS), np.int64)])
                    for total, h in zip(t, (x.h3, x.h2, x.script), strict=True):
                        total += np.bincount(h, minlength=len(total))
        for lang, t in sums.items():
            for kind, total in enumerate(t):
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([kind] * len(at), pa.int32()), pa.array(at), pa.array(total[at])], ["lang", "kind", "at", "n"])

    rows = common.mapped(labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "lang"), count, "lang string, kind int, at long, n long")
    table = rows.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toArrow()  # at most languages times the tables' sizes
    langs = sorted(set(table.column("lang").to_pylist()))
    own = np.array([langs.index(x) for x in table.column("lang").to_pylist()], np.int64)
    kind, at, n = (table.column(c).to_numpy() for c in ("kind", "at", "n"))
    out = [np.zeros((size, len(langs)), np.float32) for size in (H3, H2, len(_SCRIPTS))]
    for k, t in enumerate(out):
        t[at[kind == k], own[kind == k]] = n[kind == k]
    return Model(langs, out[0], out[1], out[2] >= SCRIPT_SHARE * np.maximum(out[2].sum(axis=0), 1))


def single(s: np.ndarray, switch: float) -> int | None:
    """The language of all words, if running sums show that no switch pays. s: [words, languages]."""
    best = int(s.sum(axis=0).argmax())
    gain = np.cumsum(s - s[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, s.shape[1])), gain[:-1]]), axis=0)
    return best if (gain - low).max() <= switch and gain.max() + (gain[-1] - low[-1]).max() <= switch else None


def walk(texts: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Viterbi's walk over the words of many texts at once, a word of each in one step."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    size = np.array([len(texts[i]) for i in order])
    first = np.cumsum(size) - size
    s = np.concatenate([texts[i] for i in order])
    came = np.empty(s.shape, np.int32)
    v, stay = s[first], np.arange(s.shape[1])
    open_ = np.searchsorted(-size, -np.arange(size[0]))  # texts that have a word t
    for t in range(1, size[0]):
        n = open_[t]
        at, now = first[:n] + t, v[:n]
        top = now.argmax(axis=1)
        other = (now[np.arange(n), top] - switch)[:, None]
        came[at] = np.where(now >= other, stay, top[:, None])
        v[:n] = np.maximum(now, other) + s[at]
    path, state = np.empty(len(s), np.int64), v.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = open_[t]
        at = first[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    out: list[np.ndarray] = [path] * len(texts)
    for i, x, n in zip(order, first.tolist(), size.tolist(), strict=True):
        out[i] = path[x : x + n]
    return out


def viterbi(texts: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The language of each word of each text: the path of the highest sum of scores less ``switch`` for
    each change. texts: [words, languages] each, none without words."""
    best = [single(s, switch) for s in texts]
    walked = iter(walk([s for s, x in zip(texts, best, strict=True) if x is None], switch) if None in best else ())
    return [next(walked) if x is None else np.full(len(s), x) for s, x in zip(texts, best, strict=True)]


class Labeller:
    """Labels texts, keeping what it scored: a word is scored once, however many texts have it. Past
    ``kept`` words it begins anew, which changes no answer."""

    def __init__(self, model: Model, kept: int = 100_000):
        self._model, self._kept = model, kept
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._scores = np.zeros((0, len(self._model.langs)))
        self._size, self._known = np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        """Number and score words that are new."""
        if len(self._number) + len(words) > self._kept:
            self._forget()
        self._number.update(zip(words, range(len(self._number), len(self._number) + len(words)), strict=True))
        model = self._model
        known = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))
        scores = model.scores(words) if model.langs else np.zeros((len(words), 0))
        self._size = np.concatenate([self._size, np.fromiter(map(len, words), np.int64, len(words)) * known])
        self._scores = np.concatenate([self._scores, scores])
        self._known = np.concatenate([self._known, known & ~np.isnan(scores).any(axis=1)])

    def label(self, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[int, str]]]]:
        """(language, score, spans) of each text; spans are (words, language) in order."""
        langs = self._model.langs
        split = [WORD.findall(t.lower()) for t in texts]
        distinct = set().union(*split)
        if len(self._number) + len(distinct) > self._kept:
            self._forget()
        if new := [w for w in distinct if w not in self._number]:
            self._learn(new)
        number, all_known = self._number, bool(self._known.all())
        rows, letters = [], []
        for words in split:
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            letters.append(self._size[ids].sum())
            rows.append(ids if all_known else ids[self._known[ids]])
        paths = iter(viterbi([self._scores[ids] for ids in rows if len(ids)]) if langs else ())
        for ids, n in zip(rows, letters, strict=True):
            if not len(ids) or not langs:
                yield "und", 0.0, []
                continue
            path = next(paths)
            weight = np.bincount(path, self._size[ids], len(langs))
            top = int(weight.argmax())
            cut = np.flatnonzero(np.diff(path)) + 1
            spans = [(int(y - x), langs[path[x]]) for x, y in zip([0, *cut], [*cut, len(path)], strict=True)]
            yield langs[top], float(weight[top] / n), spans


def label(texts: list[str], model: Model) -> Iterator[tuple[str, float, list[tuple[int, str]]]]:
    """(language, score, spans) of each text."""
    yield from Labeller(model).label(texts)


def labelled(texts: pa.Array, labeller: Labeller) -> Iterator[tuple[str, float, list[tuple[int, str]]]]:
    """Labels of an Arrow array, a part of bounded size at a time; null is empty."""
    for lo, hi in common.slices(texts, 1_000_000):
        yield from labeller.label([t or "" for t in texts[lo:hi].to_pylist()])


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) of ``docs`` (doc_id, text), with ``spans`` also the
    spans as (words, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in batches:
            got = list(labelled(b.column(2), labeller))
            out = [b.column(0), b.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            if spans:
                out.append(pa.array([[{"words": n, "lang": x} for n, x in g[2]] for g in got], pa.list_(pa.struct([("words", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score", "spans"][: len(out)])

    schema = "doc_id long, held_out boolean, lang_pred string, score double" + ", spans array<struct<words: long, lang: string>>" * spans
    return common.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), run, schema)


def accepted(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """``docs`` as they are, without those in no learned language or with a score below ``least``.
    Texts are judged beside their row, so nothing is joined and every column stays."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in batches:
            keep = [lang != "und" and score >= least for lang, score, _ in labelled(b.column(where), labeller)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return common.mapped(docs, run, docs.schema)
