"""Token ids of whole texts, by a public vocabulary of the ``tokenizers`` library."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed: the id that ends a document.
END_ID = 1
#: Bytes of texts that are best encoded together: what is held meanwhile is some twenty times that.
TEXT_BYTES = 4 << 20
#: Signs that end a word as a token of their own.
_TAILS = (",", ".")
#: First bytes of the combining marks that ASCII letters can be composed with (U+0300 to U+037F).
_MARKS = (b"\xcc", b"\xcd")
#: Words that are encoded as one text.
_AT_ONCE = 4096
#: ASCII signs that the vocabulary takes as space; Python's own class has U+001C to U+001F besides.
_SPACES = " \t\n\r\f\v"
#: Fixed by the vocabulary: how it cuts a lower-case ASCII word into runs.
_RUNS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^{_SPACES}a-z0-9]+")


class WordTokenizer:
    """Ids of texts, exact for the vocabulary ``word_bpe_49k.json``: it lowers letters, never joins
    across a space, cuts words into runs of letters, single digits and runs of other signs, and
    marks the last token of a run.

    Texts are lowered (A-Z) and cut at spaces and line ends, and distinct words are looked up in a
    table, from which the ids of the texts are gathered; all that is Arrow's and numpy's work. New
    words are encoded together as one text, whose tokens are told apart by the marks: most are a
    run of plain letters, with a comma or full stop that has an id of its own. Plain are a-z and
    those letters of Latin's further blocks that the library itself, asked once for each, takes as
    one letter that changes nothing around it. Every other word, with letters that grow when
    lowered, combine, or stand among other signs, goes to the library as it is, one by one.

    ``kept`` bounds the words held, and eight times that the bytes of them; past it only those
    used last stay.
    """

    def __init__(self, path: str, kept: int = 200_000, long_word: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._kept, self._long = kept, long_word
        vocab = self._tok.get_vocab(with_added_tokens=True)
        self._last = np.zeros(max(vocab.values()) + 1, bool)
        self._last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._bytes = np.zeros(len(self._last), np.int64)  # a token's letters stand for a byte each
        self._bytes[list(vocab.values())] = [len(t.removesuffix("</w>")) for t in vocab]
        self._words = pa.array([], pa.string())
        self._first = self._size = self._used = np.zeros(0, np.int32)
        self._flat = np.zeros(0, np.uint32)
        self._call = 0
        self._plain = f"^[a-z{self._plain_letters()}]+$"
        self._tail_ids = {t: int(x[0]) for t, x in zip(_TAILS, self._each(list(_TAILS)), strict=True) if len(x) == 1}

    def _plain_letters(self) -> str:
        """Small letters from U+00DF to U+024F that are one letter of a run in every place of a word."""
        letters = [c for c in map(chr, range(0xDF, 0x250)) if c.isalpha() and c.lower() == c]
        asked = [[c, f"a{c}b", f"{c}a", f"a{c}", f"a{c}.", f"{c}{c}"] for c in letters]
        coded = iter(self._each([w for ws in asked for w in ws]))
        dot = self._each(["."])[0].tolist()
        out = []
        for c in letters:
            got = [next(coded) for _ in range(6)]
            one_run = all(self._last[x].sum() == 1 and self._last[x[-1]] for x in (*got[:4], got[5]))
            if one_run and got[4].tolist() == [*got[3].tolist(), *dot]:
                out.append(c)
        return "".join(out)

    def _each(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tok.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str], runs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids on end, count of each) of words that are cut into so many runs, from one encoding of a few
        thousand each, as the library's own results take far more room than ids."""
        if len(words) > _AT_ONCE:
            parts = [self._together(words[i : i + _AT_ONCE], runs[i : i + _AT_ONCE]) for i in range(0, len(words), _AT_ONCE)]
            return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        ids = np.array(self._tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self._last[ids]) + 1
        if len(ends) == sum(runs):
            size = np.diff(ends[np.cumsum(runs) - 1], prepend=0)
            held = np.add.reduceat(self._bytes[ids], np.cumsum(size) - size)
            if (held == [len(w.encode()) - sum(map(w.count, _SPACES)) for w in words]).all():
                return ids, size
        own = self._each(words)  # a letter that turns into others, or one that isn't what it was taken for
        return np.concatenate(own), np.array([len(x) for x in own])

    def _append(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self._words = pa.concat_arrays([self._words, words])
        size = size.astype(np.int32)
        self._first = np.concatenate([self._first, len(self._flat) + np.cumsum(size, dtype=np.int32) - size])
        self._size = np.concatenate([self._size, size])
        self._used = np.concatenate([self._used, np.full(len(size), self._call, np.int32)])
        self._flat = np.concatenate([self._flat, ids])

    def _row(self, words: pa.Array) -> np.ndarray:
        """Rows of the table, -1 for words that it lacks."""
        return pc.fill_null(pc.index_in(words, value_set=self._words), -1).to_numpy()

    def _ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids on end, where each row's end)."""
        n = self._size[rows]
        end = np.cumsum(n, dtype=np.int32)
        at = np.repeat(self._first[rows] - (end - n), n)
        at += np.arange(len(at), dtype=np.int32)
        return self._flat[at], end

    def _forget(self) -> None:
        stay = np.flatnonzero(self._used >= self._call - 1)
        ids, size = self._ids_of(stay)[0], self._size[stay]
        words, used = self._words.take(pa.array(stay)), self._used[stay]
        self._words, self._flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self._first = self._size = self._used = np.zeros(0, np.int32)
        self._append(words, ids, size)
        self._used = used

    def _learn(self, words: pa.Array) -> None:
        tailed = pc.fill_null(pc.is_in(pc.utf8_slice_codeunits(words, -1), value_set=pa.array(list(self._tail_ids), pa.string())), False)
        bare = pc.if_else(tailed, pc.utf8_slice_codeunits(words, 0, -1), words)
        fit = pc.and_(pc.match_substring_regex(bare, self._plain), pc.less_equal(pc.utf8_length(bare), self._long))
        runs = bare.filter(fit).unique()
        runs = runs.filter(pa.array(self._row(runs) < 0))
        other = words.filter(pc.invert(fit))
        cuts = np.array([len(_RUNS.findall(w)) if w.isascii() else 0 for w in other.to_pylist()], np.int64)
        ascii_, odd = other.filter(pa.array(cuts > 0)), other.filter(pa.array(cuts == 0))
        new = [*runs.to_pylist(), *ascii_.to_pylist()]
        if new:
            self._append(pa.concat_arrays([runs, ascii_]), *self._together(new, [1] * len(runs) + cuts[cuts > 0].tolist()))
        if len(odd):
            own = self._each(odd.to_pylist())
            self._append(odd, np.concatenate(own), np.array([len(x) for x in own]))
        both = pc.and_(fit, tailed)
        with_tail = words.filter(both)
        ids, end = self._ids_of(self._row(bare.filter(both)))
        tails = np.array([self._tail_ids[w] for w in pc.utf8_slice_codeunits(with_tail, -1).to_pylist()], np.uint32)
        self._append(with_tail, np.insert(ids, end, tails), np.diff(end, prepend=0) + 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, where each text begins and the last one ends); no nulls."""
        # special tokens are told from their letters, and marks join capitals or not, before these are lowered
        raw = texts.cast(pa.binary())
        whole = pc.match_substring(raw, b"<|")
        for lead in _MARKS:
            whole = pc.or_(whole, pc.match_substring(raw, lead))
        special = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(special):
            return self._gather(texts)
        ids, bounds = self._gather(pc.if_else(whole, "", texts))
        own = self._each(texts.take(pa.array(special)).to_pylist())
        size = np.diff(bounds)
        size[special] = [len(x) for x in own]
        parts = np.split(ids, bounds[special])
        return np.concatenate([parts[0], *(x for pair in zip(own, parts[1:], strict=True) for x in pair)]), np.concatenate([[0], np.cumsum(size)])

    def _gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        self._call += 1
        rows = self._row(coded.dictionary)
        new = coded.dictionary.filter(pa.array(rows < 0))
        if len(new):
            if len(self._words) + len(new) > self._kept or self._words.nbytes > 8 * self._kept:
                self._used[rows[rows >= 0]] = self._call
                self._forget()
            self._learn(new)
            rows = self._row(coded.dictionary)
        self._used[rows] = self._call
        ids, end = self._ids_of(rows[coded.indices.to_numpy()])
        return ids, np.concatenate([[0], end], dtype=np.int64)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the end id after each text."""
        ids, bounds = self.encode(texts)
        return np.insert(ids, bounds[1:], END_ID), bounds + np.arange(len(bounds))


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
