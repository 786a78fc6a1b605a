"""Inference where observations of one period move together: errors by clusters, and a bootstrap that draws whole clusters.

Observations fold into a sum and a count for each group and cluster first, so both methods read one small row a cluster, whatever the rows behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def cluster_sums(rows: DataFrame, groups: list[str], cluster: str, value: str) -> DataFrame:
    """``groups, cluster, s, n``: sum and count of the values that are not null."""
    return rows.where(F.col(value).isNotNull()).groupBy(*groups, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))


def clustered_mean(sums: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, mean, std_error, n, n_clusters, t_stat``: the mean, and its error from the clusters' residual sums (with the small-sample factor G / (G - 1)).

    Null where there is one cluster or no spread.
    """
    total = sums.groupBy(*groups).agg(F.sum("s").alias("_s"), F.sum("n").alias("n"), F.count("*").alias("n_clusters"), F.sum(F.col("s") * F.col("s")).alias("_ss"), F.sum(F.col("s") * F.col("n")).alias("_sn"), F.sum(F.col("n") * F.col("n")).alias("_nn"))
    mean, g = F.col("_s") / F.col("n"), F.col("n_clusters")
    squares = F.greatest(F.lit(0.0), F.col("_ss") - 2 * mean * F.col("_sn") + mean * mean * F.col("_nn"))
    error = F.when(g > 1, F.sqrt(squares * g / (g - 1)) / F.col("n"))
    return total.select(*groups, mean.alias("mean"), error.alias("std_error"), "n", "n_clusters", F.try_divide(mean, F.nullif(error, F.lit(0.0))).alias("t_stat"))


def poisson_steps(most: int = 8) -> list[float]:
    """Chances that a Poisson number of mean 1 is at most 0, 1, and so on."""
    each = [math.exp(-1) / math.factorial(k) for k in range(most)]
    return [sum(each[: k + 1]) for k in range(most)]


def weight(cluster: Column, draw: Column, seed: int) -> Column:
    """How often a draw takes a cluster: a Poisson number out of a hash, so alike in any engine and on any rerun."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), cluster.cast("string"), draw.cast("string")))
    u = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return sum((u > p).cast("int") for p in poisson_steps())


def bootstrap(sums: DataFrame, groups: list[str], cluster: str, draws: int, seed: int = 1) -> DataFrame:
    """``groups, draw, mean``: the mean in each of ``draws`` Poisson resamples of clusters; draws that take none of a group's clusters are missing.

    Groups share a draw's weights, so differences between groups keep what a cluster does to both.
    """
    each = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", weight(F.col(cluster), F.col("draw"), seed))
    out = each.where("_w > 0").groupBy(*groups, "draw").agg(F.sum(F.col("_w") * F.col("s")).alias("_s"), F.sum(F.col("_w") * F.col("n")).alias("_n"))
    return out.select(*groups, "draw", (F.col("_s") / F.col("_n")).alias("mean"))
