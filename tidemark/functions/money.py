"""Returns and their like."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def simple_return(now: Column, before: Column) -> Column:
    return F.try_divide(now, before) - 1


def log_return(now: Column, before: Column) -> Column:
    return F.when((now > 0) & (before > 0), F.log(now / before))


def t_statistic(x: Column) -> Column:
    """Mean over its standard error; null for fewer than two values or no spread."""
    return F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(x)))
