"""Token counts under a public tokenizer vocabulary (a .tiktoken file whose path is a parameter)."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: word pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens as a long; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: count(t, path)).astype("int64")

    return f(text)
