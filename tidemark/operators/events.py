"""Event studies: a trading-day index, event windows by equi-join, abnormal returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.money import t_statistic


def trading_index(dates: DataFrame, time: str) -> DataFrame:
    """``time, idx``: distinct dates in order. The unpartitioned window sees one row per date of the calendar, never the bars."""
    return dates.select(time).distinct().withColumn("idx", F.row_number().over(Window.orderBy(time)))


def event_window(events: DataFrame, returns: DataFrame, calendar: DataFrame, by: str, time: str, before: int, after: int) -> DataFrame:
    """Events spread over offsets and joined to returns on (security, day index): never a range join.

    ``events`` needs ``by`` and ``time`` (a date of the calendar); both tables keep their columns. Offsets over the calendar's edge have no rows.
    """
    spread = events.join(calendar, time).withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("at", F.col("idx") + F.col("offset")).drop("idx", time)
    series = returns.join(calendar, time).withColumnRenamed("idx", "at")
    return spread.join(series, [by, "at"]).drop("at")


def abnormal(ret: Column, market: Column, alpha: Column | None = None, beta: Column | None = None) -> Column:
    """Market-adjusted return, or the residual of the market model."""
    return ret - market if alpha is None else ret - alpha - beta * market


def mean_abnormal(windows: DataFrame, groups: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return windows.where(v.isNotNull()).groupBy(*groups).agg(F.avg(v).alias("mean_ar"), F.stddev_samp(v).alias("std_ar"), F.count(v).alias("n"), t_statistic(v).alias("t_stat"))


def cumulative(windows: DataFrame, event: list[str], value: str) -> DataFrame:
    """Adds ``car``: the sum of abnormal returns from the window's start."""
    w = Window.partitionBy(*event).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumn("car", F.sum(value).over(w))


def lead_time(news: DataFrame, cluster: str, kind: str, time: str, first: str, second: str) -> DataFrame:
    """Per story seen in both kinds: minutes by which ``first`` leads ``second``. One aggregation, no self-join."""
    seen = lambda k: F.min(F.when(F.col(kind) == k, F.col(time)))
    both = news.groupBy(cluster).agg(seen(first).alias("_a"), seen(second).alias("_b")).where("_a is not null and _b is not null")
    minutes = (F.unix_seconds(F.col("_b").cast("timestamp")) - F.unix_seconds(F.col("_a").cast("timestamp"))) / 60
    return both.select(cluster, minutes.alias("lead_minutes"))
