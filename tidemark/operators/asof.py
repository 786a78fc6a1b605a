"""As-of joins by union and a window: one shuffle, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """Each left row with the right row of the same ``by`` whose time is nearest, not after (``backward``) or not before (``forward``) it.

    ``strict`` excludes equal times, as a decision that may not see its own moment needs. Several right rows of one time are a
    tie: the one with the largest ``values`` wins. Left rows without a match keep nulls. Right rows' times come as ``right_ts``
    with ``asof_`` before it, like ``values``. ``left`` may not have columns named ``_side`` or ``_v``.
    """
    forward = direction == "forward"
    if direction not in ("forward", "backward"):
        raise ValueError(direction)
    packed = F.struct(F.col(right_ts).alias(right_ts), *(F.col(v).alias(v) for v in values))
    keys = [F.col(k).alias(k) for k in by]
    # At equal times an inclusive join sees right rows first when looking back, and last when looking ahead.
    left_place = int(forward == strict)
    a = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(left_place).alias("_side"), F.struct("*").alias("_row"))
    b = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(1 - left_place).alias("_side"), packed.alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    window = Window.partitionBy(*by)
    # Looking ahead is looking back in reverse order: a frame to the end of the partition would be read anew for every row.
    order = [F.col("_t").desc(), F.col("_side").desc()] if forward else ["_t", "_side"]
    found = F.last("_v", ignorenulls=True).over(window.orderBy(*order, F.col("_v").asc()).rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("_v", found).where(F.col("_row").isNotNull())
    return got.select("_row.*", *(F.col(f"_v.{c}").alias(f"asof_{c}") for c in (right_ts, *values)))


def gap_fill(grid: DataFrame, table: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """``grid`` (``by``, ``time``) with the last known ``values``."""
    joined = grid.join(table.select(*by, time, *values), [*by, time], "left")
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*by, time, *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values))
