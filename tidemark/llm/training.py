"""Bounded samples of labelled rows, and the small optimiser that both classifiers train with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE_PER_CLASS = 2000
SAMPLE_CHARS = 20_000_000


def remainder(doc_id, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id has none and counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights to learn from, never with ``crc32(doc_id) % mod == held_out``.

    The bound: of each class the ``per_class`` ids that come first by a hash, and of these whole texts, in that order, as long as they hold at most ``chars``
    characters together; a text of more than ``chars`` by itself gives its first stretch. Labels without a document do not count. Weights restore the share of the classes among all usable labels.
    Rows with equal id count once (highest label, first text).
    """
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(remainder("doc_id", mod) != held_out)
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = dict.fromkeys((0, 1), 0) | {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    likely = {y: place < min(1 << 30, (2 * per_class << 30) // max(share[y], 1)) for y in (0, 1)}  # spares the sort most rows
    picked = [usable.where((F.col("y") == y) & likely[y]).orderBy(place, "doc_id").limit(per_class) for y in (0, 1)]
    picked = picked[0].union(picked[1])  # at most 2 * per_class rows: small enough to broadcast
    texts = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    before = Window.partitionBy("y").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")  # over the picked rows
    rows = rows.withColumn("_sum", F.sum(F.length("text")).over(before)).where(F.col("_sum") <= chars).select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in rows], np.float64)
    got = [max(1, int((y == k).sum())) for k in (0, 1)]
    weight = np.where(y == 1, share[1] / got[1], share[0] / got[0])
    return [r.text for r in rows], y, weight / weight.mean() if len(weight) else weight


def adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * min(1.0, 2 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over ``raw`` (Platt); the slope never falls below zero."""
    if not len(raw) or y.min() == y.max():
        return 0.0, 0.0 if not len(raw) else 6.0 * (2 * y[0] - 1)
    centre, scale = raw.mean(), raw.std() + 1e-9
    x = (raw - centre) / scale

    def gradient(p):
        e = weight * (sigmoid(np.exp(p[0]) * x + p[1]) - y)
        return np.array([(e * x).mean() * np.exp(p[0]) + 1e-3 * p[0], e.mean()])

    a, b = adam(gradient, np.zeros(2), 400, 0.1)
    return float(np.exp(a) / scale), float(b - np.exp(a) * centre / scale)
