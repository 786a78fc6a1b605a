"""Price bars: resampling, returns, rolling statistics, drawdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.money import log_return, simple_return


def resample(trades: DataFrame, by: str, ts: str, price: str, volume: str, unit: str = "month") -> DataFrame:
    """``by, period, open, high, low, close, volume, vwap``. Trades of one instant are averaged first, so open and close are unique."""
    at = trades.groupBy(by, ts).agg(F.try_divide(F.sum(F.col(price) * F.col(volume)), F.sum(volume)).alias("_p"), F.max(price).alias("_h"), F.min(price).alias("_l"), F.sum(volume).alias("_v"), F.sum(F.col(price) * F.col(volume)).alias("_n"))
    return at.groupBy(by, F.date_trunc(unit, ts).cast("date").alias("period")).agg(
        F.min_by("_p", ts).alias("open"), F.max("_h").alias("high"), F.min("_l").alias("low"), F.max_by("_p", ts).alias("close"), F.sum("_v").alias("volume"), F.try_divide(F.sum("_n"), F.sum("_v")).alias("vwap")
    )


def with_returns(bars: DataFrame, by: str, time: str, price: str) -> DataFrame:
    """Adds ``ret`` and ``log_ret`` from the bar before, ``fwd`` to the bar after, and ``hold`` from the bar after to the one after that.

    A bar's price averages its whole span, so what is learned within the span cannot trade on it: ``hold`` is what a decision at its end can earn.
    """
    w = Window.partitionBy(by).orderBy(time)
    p, before, after, then = F.col(price), F.lag(price).over(w), F.lead(price).over(w), F.lead(price, 2).over(w)
    return bars.withColumns({"ret": simple_return(p, before), "log_ret": log_return(p, before), "fwd": simple_return(after, p), "hold": simple_return(then, after)})


def rolling(bars: DataFrame, by: str, time: str, value: str, rows: int) -> DataFrame:
    """Adds mean, deviation and count of the last ``rows`` bars, the current one included."""
    w = Window.partitionBy(by).orderBy(time).rowsBetween(1 - rows, 0)
    return bars.withColumn("roll_mean", F.avg(value).over(w)).withColumn("roll_std", F.stddev_samp(value).over(w)).withColumn("roll_n", F.count(value).over(w))


def rolling_days(bars: DataFrame, by: str, day: str, value: str, days: int) -> DataFrame:
    """Adds mean and count over the last ``days`` days, however many bars they hold, the current one included."""
    w = Window.partitionBy(by).orderBy(F.unix_date(day)).rangeBetween(1 - days, 0)
    return bars.withColumn("span_mean", F.avg(value).over(w)).withColumn("span_n", F.count(value).over(w))


def drawdown(returns: DataFrame, by: list[str], time: str, ret: str) -> DataFrame:
    """Adds ``wealth`` (1 before the first return), its running ``peak`` (1 at least) and ``drawdown``."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("wealth", F.exp(F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0)))).over(w)))
    peak = grown.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    return peak.withColumn("drawdown", F.col("wealth") / F.col("peak") - 1)


def market_model(returns: DataFrame, by: str, own: str, market: str) -> DataFrame:
    """Slope, intercept, correlation and count of own on market returns."""
    r = returns.where(F.col(own).isNotNull() & F.col(market).isNotNull())
    return r.groupBy(by).agg(F.regr_slope(own, market).alias("beta"), F.regr_intercept(own, market).alias("alpha"), F.corr(own, market).alias("corr"), F.count("*").alias("n"))


def rolling_market_model(returns: DataFrame, by: str, time: str, own: str, market: str, rows: int, gap: int, least: int = 6) -> DataFrame:
    """Adds ``alpha``, ``beta`` and ``fit_n`` of own on market returns over the ``rows`` bars that end ``gap`` bars before the current one.

    An event window of ``gap`` bars before the event thus has no part in what counts as normal for it. Null below ``least`` usable bars.
    """
    w = Window.partitionBy(by).orderBy(time).rowsBetween(-(rows + gap), -(gap + 1))
    n = F.regr_count(own, market).over(w)
    fit = returns.withColumns({"fit_n": n, "beta": F.regr_slope(own, market).over(w), "alpha": F.regr_intercept(own, market).over(w)})
    usable = (F.col("fit_n") >= least) & F.col("beta").isNotNull()
    return fit.withColumns({"alpha": F.when(usable, F.col("alpha")), "beta": F.when(usable, F.col("beta"))})
