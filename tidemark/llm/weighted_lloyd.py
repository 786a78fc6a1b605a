"""Centroid clustering on distinct vectors: equal quantised vectors are one row with a multiplicity, Lloyd's rounds weigh it, and assignments go back by vector.

A component x becomes floor(1024 * x). Sums of weighted components are exact integers, added up by task and then by centroid, so the result does not depend on how rows
are dealt. A round moves one sum for each task, centroid and component; the driver holds the centroids alone.

Defined cases: vectors that are null, of another size, or hold a null or non-finite component take no part; repeated rows weigh as often as they
come; a null ``vec_id`` keeps its row, and seeds a centroid only where other rows are too few; fewer vectors than centroids make fewer centroids; an
empty table gives no rows; further columns are ignored. Numbers beyond 64 bits (components above some hundred million) are added in Python's integers, and a
``distance`` or an inertia that does not fit is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import materialize

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
_SAFE = 1 << 26
_FITS = (1 << 63) - 1
_LONG_SUM = "decimal(38,0)"
_PART = 10**30  # sums travel as a multiple of this and a rest, so that tasks' sums add up in 38 digits


def quantised(vectors: DataFrame, size: int) -> DataFrame:
    """``vec_id, v``: usable vectors, their components whole numbers kept as doubles."""
    usable = vectors.where((F.size("embedding") == size) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return usable.select("vec_id", F.transform("embedding", lambda c: _floor(c.cast("double") * SCALE)).alias("v"))


def _floor(x):
    """Of doubles, as a double; beyond 2^52 every double is whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def seeds(rows: DataFrame, count: int) -> np.ndarray:
    """Vectors of the rows that come first by the SHA-256 of ``3:<vec_id>``."""
    digest = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "vec_id", "v").limit(count).select("v").collect()
    return np.array([[int(c) for c in r.v] for r in first], object)


def whole(lists: pa.ListArray, size: int) -> np.ndarray:
    """Rows of integers: of 64 bits where squares of their differences fit, else Python's."""
    x = lists.flatten().to_numpy().reshape(-1, size)
    return x.astype(np.int64) if not x.size or np.abs(x).max() < _SAFE else np.array([[int(c) for c in row] for row in x], object).reshape(-1, size)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid and squared distance; ties go to the smaller number."""
    if x.dtype != object and len(centroids) and max(abs(int(c)) for c in centroids.ravel()) < _SAFE:
        centroids = centroids.astype(np.int64)
    best, far = np.zeros(len(x), np.int64), None
    for k, c in enumerate(centroids):
        d = ((x - c) ** 2).sum(axis=1)
        if far is None:
            far = d
        else:
            closer = (d < far).astype(bool)
            best[closer], far[closer] = k, d[closer]
    return best, far


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``v, cluster, distance, weight`` of each distinct vector."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, d = nearest(whole(batch.column(0), size), centroids)
            far = pa.array([Decimal(int(v)) if v <= 10**37 else None for v in d], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k.astype(np.int32)), far, batch.column(1)], names=["v", "cluster", "distance", "weight"])

    return distinct.select("v", "weight").mapInArrow(run, f"v array<double>, cluster int, distance {_LONG_SUM}, weight long")


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of their vectors' weighted means; those without vectors stay."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), size), object), [0] * len(centroids)
        for batch in batches:
            x, w = whole(batch.column(0), size), batch.column(1).to_numpy()
            k, _ = nearest(x, centroids)
            small = x.dtype != object and float(w.sum()) * _SAFE < 2**62
            for c in np.unique(k).tolist():
                own = k == c
                total[c] += (x[own] * w[own, None]).sum(axis=0).astype(object) if small else (x[own].astype(object) * w[own, None].astype(object)).sum(axis=0)
                count[c] += int(w[own].sum())
        at = [(c, i) for c in range(len(centroids)) if count[c] for i in range(size)]
        part = lambda f: pa.array([Decimal(int(f(total[c][i]))) for c, i in at], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in at], pa.int32()), pa.array([i for _, i in at], pa.int32()), pa.array([count[c] for c, _ in at], pa.int64()), part(lambda v: v // _PART), part(lambda v: v % _PART)], names=["cluster", "i", "n", "high", "low"])

    sums = distinct.select("v", "weight").mapInArrow(run, f"cluster int, i int, n long, high {_LONG_SUM}, low {_LONG_SUM}")
    new = centroids.copy()
    for r in sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # a number for each centroid and component
        new[r.cluster][r.i] = (int(r.high) * _PART + int(r.low)) // r.n
    return new


def cluster(vectors: DataFrame, size: int = SIZE, count: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each usable vector."""
    rows = materialize(quantised(vectors, size), "lloyd-rows")
    distinct = materialize(rows.groupBy("v").agg(F.count("*").alias("weight")), "lloyd-distinct")
    centroids = seeds(rows, count).reshape(-1, size)
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    of_vector = materialize(assigned(distinct, centroids), "lloyd-assigned")
    fits = lambda c: F.when(c <= _FITS, c).cast("long")
    inertia = of_vector.groupBy("cluster").agg(F.sum((F.col("distance") * F.col("weight")).cast(_LONG_SUM)).alias("i")).collect()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = {r.cluster: r.i for r in inertia}
    at = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values), F.lit(None).cast(kind)), F.col("cluster"))
    every = sum(map(int, own.values())) if None not in own.values() else None
    shown = lambda v: int(v) if v is not None and v <= _FITS else None
    back = rows.join(of_vector.select("v", "cluster", fits(F.col("distance")).alias("distance")), "v")
    return back.select("vec_id", "cluster", "distance", at([shown(own.get(k)) for k in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(shown(every)).cast("long").alias("inertia"), at(digests, "string").alias("centroid_sha256"))
