"""Embedding of texts by exchangeable backends; the default one hashes words to a unit vector and needs no model.

Null texts and texts without words have no vector (null), which keeps their place in a batch.
"""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kbforge.operators.search import terms


class Embedder(Protocol):
    name: str
    dim: int

    def validate(self) -> None:
        """Raises ValueError if the backend's model isn't there."""

    def column(self, text: Column) -> Column:
        """array<double> of length dim, or null."""


class HashedEmbedder:
    """Signed feature hashing of words, normalised to length 1: equal in every engine that has MD5."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.name = dim, f"hashed-{dim}"

    def validate(self) -> None:
        if self.dim < 1:
            raise ValueError("an embedding needs at least one dimension")

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<double>")
        def embed(words: pd.Series) -> pd.Series:
            known: dict[str, tuple[int, int]] = {}

            def place(w: str) -> tuple[int, int]:
                if w not in known:
                    if len(known) > 500_000:
                        known.clear()
                    h = hashlib.md5(w.encode()).hexdigest()
                    known[w] = int(h[:8], 16) % dim, 1 - 2 * (int(h[8], 16) % 2)
                return known[w]

            def one(ws) -> list[float] | None:
                if ws is None or not len(ws):
                    return None
                at, sign = zip(*map(place, ws), strict=True)
                v = np.bincount(at, weights=sign, minlength=dim)
                n = np.sqrt((v * v).sum())
                return (v / n).tolist() if n else None

            return words.map(one)

        return embed(terms(text))


class ListedBackend:
    """A check that a served model is there: its name must be part of a listed one."""

    def __init__(self, model: str, listed: list[str] | None) -> None:
        self.model, self.listed = model, listed

    def validate(self) -> None:
        """A list that can't be had (None) is let pass; a list without the model isn't."""
        if self.listed is not None and not any(self.model in x for x in self.listed):
            raise ValueError(f"model {self.model} is not listed")
