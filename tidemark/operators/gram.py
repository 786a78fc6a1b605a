"""Walk-forward ridge regression in one pass over the panel: a month's products add up, and a fold's normal equations are sums over its months.

A period keeps the sums of all products of features and target (a Gram matrix); they are as many as the features squared, so the periods' table is as
small as the calendar. Training spans that overlap cost nothing more, and no fold reads the panel again but to be scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def period_grams(panel: DataFrame, time: str, features: list[str], target: str) -> DataFrame:
    """``time, n, g``: the count, and the sums of products of (1, features, target), the upper triangle row by row. Rows with a null in any of them take no part."""
    usable = panel.dropna(subset=[*features, target])
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in (*features, target))]
    products = [F.sum(z[i] * z[j]).alias(f"_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    sums = usable.groupBy(time).agg(F.count("*").alias("n"), *products)
    return sums.select(time, "n", F.array(*(c for c in sums.columns if c.startswith("_"))).alias("g"))


def solve(n: int, flat: np.ndarray, ridge: float) -> list[float] | None:
    """Intercept and weights of one fold from its summed triangle; the penalty acts on standardised features, a constant feature weighs nothing."""
    size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    if not n:
        return None
    g = np.zeros((size, size))
    g[np.triu_indices(size)] = flat
    g = (g + np.triu(g, 1).T) / n
    mean = g[0]
    c = g - np.outer(mean, mean)
    x, y = slice(1, size - 1), size - 1
    scale = np.sqrt(np.maximum(np.diag(c)[x], 0))
    live = scale > 1e-9 * np.maximum(np.abs(mean[x]), 1e-12)
    w = np.zeros(size - 2)
    if live.any():
        s = scale[live]
        a = c[x, x][np.ix_(live, live)] / np.outer(s, s) + ridge * np.eye(live.sum())
        w[live] = np.linalg.lstsq(a, c[x, y][live] / s, rcond=None)[0] / s
    return [float(mean[y] - mean[x] @ w), *map(float, w)]


def fold_weights(panel: DataFrame, folds: DataFrame, time: str, features: list[str], target: str, ridge: float, horizon: int = 0) -> DataFrame:
    """``fold, test_from, test_to, n, w``: each fold's solution (intercept first). ``horizon`` is how many periods a target reaches into: a fold learns
    from periods whose targets are known when its test begins.
    """
    grams = period_grams(panel, time, features, target)
    at = folds.alias("f").join(panel.select(time).distinct().alias("d"), F.col(f"d.{time}") < F.col("f.test_from"))
    known = at.groupBy("fold").agg(F.slice(F.array_sort(F.collect_list(F.col(f"d.{time}"))), -horizon, 1)[0].alias("_until")) if horizon else None  # a calendar, by fold
    spans = folds.join(known, "fold") if horizon else folds.withColumn("_until", F.col("test_from"))
    inside = spans.join(grams, (F.col(time) >= F.col("train_from")) & (F.col(time) < F.col("_until")))  # periods by folds, both of the calendar
    places = inside.select("fold", "test_from", "test_to", "n", F.posexplode("g").alias("_at", "_v"))
    summed = places.groupBy("fold", "test_from", "test_to", "_at").agg(F.sum("_v").alias("_v"), F.sum("n").alias("n"))
    whole = summed.groupBy("fold", "test_from", "test_to").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda p: p["_v"]).alias("g"))

    @F.pandas_udf("array<double>")
    def solved(n: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([solve(int(k), np.asarray(v, float), ridge) for k, v in zip(n, g)])

    return whole.select("fold", "test_from", "test_to", "n", solved("n", "g").alias("w"))


def walk_forward(panel: DataFrame, folds: DataFrame, time: str, features: list[str], target: str, ridge: float = 0.1, horizon: int = 0) -> DataFrame:
    """``panel``'s rows within a test, with ``fold`` and ``score``. Overlapping tests score a row once each."""
    weights = fold_weights(panel, folds, time, features, target, ridge, horizon)
    tests = weights.join(panel.select(time).distinct(), (F.col(time) >= F.col("test_from")) & (F.col(time) <= F.col("test_to"))).select("fold", time, "w")
    score = sum((F.get("w", F.lit(k + 1)) * F.col(c) for k, c in enumerate(features)), F.get("w", F.lit(0)))
    return panel.join(tests, time).select(*panel.columns, "fold", score.alias("score"))
