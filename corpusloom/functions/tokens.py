"""Exact token counts by a vocabulary file that is at hand: byte-pair ranks (``.tiktoken``) or a
tokenizer description (``.json``). Special tokens in a text are its letters. The file has to be
where every executor can open it."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how the public byte-level vocabularies cut a text before pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NOTE = "\n... [truncated to fit token budget]"


@cache
def _loaded(path: str) -> tuple[Callable[[str], list[int]], Callable[[list[int]], str]]:
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda t: tok.encode(t, add_special_tokens=False).ids, tok.decode
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary, own.decode


def counter(path: str) -> Callable[[str], int]:
    """Tokens of a text, loaded where it is first called."""
    return lambda text: len(_loaded(path)[0](text))


def count(path: str, text: Column) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(counter(path), na_action="ignore")

    return run(text)


def truncated(path: str, text: Column, tokens: Column) -> Column:
    """The first so many tokens of a text, and a note."""

    @F.pandas_udf("string")
    def run(text: pd.Series, tokens: pd.Series) -> pd.Series:
        encode, decode = _loaded(path)
        return pd.Series([decode(encode(t)[:n]) + NOTE for t, n in zip(text, tokens, strict=True)])

    return run(text, tokens)
