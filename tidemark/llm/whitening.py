"""Embedding whitening: the covariance of exactly centred rows by MLlib's ``RowMatrix``, and its eigenvectors applied in tasks.

Components become integers, x = floor(1024 * c) + 100000, so sums S over all n rows are exact, and so is a row centred as n * x - S. The Gramian
of the centred rows over n is the covariance; it is as large as the dimensions alone, so its eigenvectors are found on the driver
and travel to the tasks. The covariance of the whitened rows is measured again from the rows themselves.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; vectors of different lengths
are whitened apart, each length with its own n; repeated rows count as often as they come; a null ``vec_id`` keeps its rows; a component without
variance (eigenvalue zero up to rounding) has a null ``whitened``; ``explained`` is null where nothing varies; an empty table gives no rows; further
columns are ignored. ``deviation`` is null where it needs more than 64 bits. Components may
reach some 10^12: beyond, n * x leaves 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import materialize

SCALE, SHIFT, MOST = 1024, 100_000, 8


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: usable vectors as longs."""
    usable = vectors.where((F.size("embedding") > 0) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return usable.select("vec_id", F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")) + F.lit(SHIFT).cast("long")).alias("x"))


def sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""
    r = rows.agg(F.count("*").alias("n"), *(F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size))).first()
    return r[0], [int(s) for s in r[1:]]


def covariance(rows: DataFrame, column: str, n: int, size: int) -> np.ndarray:
    """Of rows whose mean is zero: their Gramian over n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, size).computeGramianMatrix().toArray() / n


def fit(rows: DataFrame, size: int) -> dict:
    """Sums, eigenvalues in falling order, unit eigenvectors as columns, and the covariance's trace."""
    n, s = sums(rows, size)
    total = F.array(*(F.lit(v).cast("long") for v in s))
    centred = rows.select(F.transform(F.arrays_zip("x", total.alias("s")), lambda p: (F.lit(n).cast("long") * p["x"] - p["s"]).cast("double") / n).alias("c"))
    v = covariance(centred, "c", n, size)
    values, axes = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], axes[:, order]
    values = np.where(values > size * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    return {"n": n, "sums": s, "values": values, "axes": axes, "trace": float(np.trace(v))}


def exact_squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares by row, in Python's integers where 64 bits may not do."""
    if not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
        return (d * d).sum(axis=1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in d)
    return [e if e < 2**63 else None for e in exact]


def projected(rows: DataFrame, model: dict) -> DataFrame:
    """``vec_id, deviation, w``: the whitened components of each row, null where there is no variance."""
    n, s, k = model["n"], np.array(model["sums"], np.int64), min(MOST, len(model["values"]))
    values, axes = model["values"][:k], model["axes"][:, :k]
    live = values > 0
    turn = axes[:, live] / np.sqrt(values[live])

    sent = rows.sparkSession.sparkContext.broadcast((s, turn, live))  # as large as the dimensions

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, turn, live = sent.value
        for frame in frames:
            x = np.array(frame["x"].tolist(), np.int64).reshape(len(frame), len(s))
            d = n * x - s
            w = np.full((len(x), k), np.nan)
            w[:, live] = (d / n) @ turn
            yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": pd.array(exact_squares(d), "Int64"), "w": list(w)})

    done = rows.select("vec_id", "x").mapInPandas(run, f"vec_id {dict(rows.dtypes)['vec_id']}, deviation long, w array<double>")
    return done.withColumn("w", F.transform("w", lambda c: F.when(~F.isnan(c), c)))


def identity_error(rows: DataFrame, model: dict) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over components with variance."""
    live = np.flatnonzero(model["values"][:MOST] > 0)
    if not len(live):
        return 0.0
    w = rows.select(F.array(*(F.get("w", F.lit(int(i))) for i in live)).alias("w"))
    mean = w.select(Summarizer.mean(array_to_vector("w"))).first()[0]
    centre = F.array(*(F.lit(float(m)) for m in mean))
    c = covariance(w.select(F.transform(F.arrays_zip("w", centre.alias("m")), lambda p: p["w"] - p["m"]).alias("c")), "c", model["n"], len(live))
    return float(np.abs(c - np.eye(len(live))).max())


def whiten(vectors: DataFrame) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and each of its first ``MOST`` components."""
    rows = materialize(quantised(vectors), "whitening-rows")
    lengths = [r.d for r in rows.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]
    kind = dict(rows.dtypes)["vec_id"]
    out = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for size in lengths:
        own = rows.where(F.size("x") == size)
        model = fit(own, size)
        done = materialize(projected(own, model), "whitened")
        share = [float(v / model["trace"]) if model["trace"] > 0 else None for v in model["values"][:MOST]]
        each = done.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
        shares = F.array(*(F.lit(v).cast("double") for v in share))
        out = out.unionByName(each.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(identity_error(done, model)).alias("identity_error")))
    return out
