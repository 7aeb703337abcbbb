"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: A rank file: one base64 token and its rank a line.
VOCABULARY = os.environ.get("RECALLSPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str = VOCABULARY):
    """One encoder per worker and file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def cut_to_capacity(text: str, capacity: int, path: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of consecutive parts of at most ``capacity`` tokens.

    Cuts fall before a space that begins a word, where counts of the parts add up
    to the count of the text; failing one, before any token that begins a character.
    """
    enc = encoder(path)
    ids = enc.encode_ordinary(text)
    if len(ids) <= capacity:
        return [(0, len(text), len(ids))]
    _, offsets = enc.decode_with_offsets(ids)
    parts, at = [], 0
    while at < len(ids):
        end = min(at + capacity, len(ids))
        if end < len(ids):
            for i in range(end, max(at + 3 * capacity // 4, at), -1):
                o = offsets[i]
                if text[o] == " " and not text[o + 1 : o + 2].isspace() and not text[o - 1].isspace():
                    end = i
                    break
            else:
                while end - 1 > at and offsets[end] == offsets[end - 1]:
                    end -= 1
        start, stop = offsets[at], offsets[end] if end < len(ids) else len(text)
        size = len(enc.encode_ordinary(text[start:stop]))
        while size > capacity:  # a cut inside a word may encode worse on its own
            end -= max(1, (size - capacity + 1) // 2)
            stop = offsets[end]
            size = len(enc.encode_ordinary(text[start:stop]))
        if stop <= start:  # one character of more tokens than fit
            raise ValueError("the capacity is smaller than one character")
        parts.append((start, stop, size))
        at = end
    return parts


def with_token_counts(df: DataFrame, text: str, columns: list[str], path: str = VOCABULARY) -> DataFrame:
    """``columns`` of ``df`` and ``tokens``, the size of its column ``text``."""
    kept = df.select(*columns, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text) + ", tokens bigint"

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = [count_tokens(t, path) for t in frame[text]]
            yield frame.drop(columns=[text]).assign(tokens=pd.Series(sizes, index=frame.index, dtype="int64"))

    return kept.mapInPandas(count, schema)
