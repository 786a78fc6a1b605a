"""Vector expressions; Spark has no cosine for arrays."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision, terms added in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def load_hashing(size: int = 64) -> Callable[[list[str]], list[np.ndarray]]:
    """A deterministic stand-in for an embedding model: words hashed with a sign into ``size`` places, the vector at unit length. Texts without words are zero."""

    def one(text: str) -> np.ndarray:
        v = np.zeros(size)
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h // 2 % size] += 1 if h % 2 else -1
        if not v.any():  # the signs of all words cancel: without them, a text with words is never zero
            for w in re.findall(r"\w+", text.lower()):
                v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") // 2 % size] += 1
        return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)

    return lambda texts: [one(t) for t in texts]


def embed(news: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[np.ndarray]]] = load_hashing, batch: int = 64) -> DataFrame:
    """Adds ``embedding`` (floats); null for a text the model cannot read."""
    from tidemark.operators.inference import over_batches

    run = over_batches(load, None, batch)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for got in run(batches):
            yield pd.Series(got, dtype=object)

    return news.withColumn("embedding", vectors(text))
