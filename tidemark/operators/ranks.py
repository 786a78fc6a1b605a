"""Global ranks without a single task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.work import cut


def number_rows(table: DataFrame, order: list[str], name: str = "numbered") -> DataFrame:
    """Adds ``row_no`` (from 1) and ``n_rows``: places in the global order of the columns ``order``, nulls first.

    Rows are dealt by range and numbered within their range; what lies before a range is a running sum over one row per
    range. ``order`` should be total: rows that tie in all of it lie in one range and are numbered in any order.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    # The ranges are written with their numbers: a second run might draw other boundaries.
    ranged = cut(table.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), name)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    every, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("n_rows"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranged.withColumn("_own", own).join(starts, "_range").withColumn("row_no", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def bucket_of(row_no: Column, n_rows: Column, buckets: int) -> Column:
    """What ``ntile`` gives for a place among ``n_rows``: the first ``n_rows % buckets`` buckets hold one row more."""
    small, extra = F.floor(n_rows / buckets), n_rows % buckets
    large_rows = extra * (small + 1)
    in_large = F.floor((row_no - 1) / (small + 1)) + 1
    in_small = extra + F.try_divide(row_no - 1 - large_rows, small).cast("long") + 1
    return F.when(row_no <= large_rows, in_large).otherwise(in_small).cast("int")


def percent_rank(numbered: DataFrame, by: str, name: str) -> DataFrame:
    """Adds ``name``: the share of the other rows that come before, equal values of ``by`` alike. Takes what ``number_rows`` gives, ordered by ``by`` first."""
    first = numbered.groupBy(F.col(by).alias("_by")).agg(F.min("row_no").alias("_first"))
    share = F.coalesce(F.try_divide((F.col("_first") - 1).cast("double"), (F.col("n_rows") - 1).cast("double")), F.lit(0.0))
    return numbered.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, share).drop("_by", "_first")
