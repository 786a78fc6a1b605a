"""Portfolio rules, weights, walk-forward folds and backtest reports. Defaults are ours; the rules' parameters are not published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TOP_K, TEMPERATURE, PERIODS_A_YEAR = 5, 1.0, 12


def top_k(panel: DataFrame, date: str, order: list[Column], k: int = TOP_K) -> DataFrame:
    """The k best of each date; ``order`` must be total."""
    return panel.withColumn("rank", F.row_number().over(Window.partitionBy(date).orderBy(*order))).where(F.col("rank") <= k)


def equal_weights(held: DataFrame, date: str) -> DataFrame:
    return held.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy(date)))


def softmax_weights(held: DataFrame, date: str, score: str, temperature: float = TEMPERATURE) -> DataFrame:
    """exp(score / temperature) normalised per date; the date's largest score is taken off first, so no score overflows."""
    w = Window.partitionBy(date)
    e = held.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    return e.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def cash_exit(held: DataFrame, gate: DataFrame, date: str, keep: Column, cut_to: float = 0.0) -> DataFrame:
    """Weights times ``cut_to`` on dates where ``keep`` (over ``gate``'s columns) is not true; what is missing to 1 is cash."""
    g = gate.select(date, F.when(F.coalesce(keep, F.lit(False)), 1.0).otherwise(cut_to).alias("_g"))
    return held.join(g, date, "left").withColumn("weight", F.col("weight") * F.coalesce("_g", F.lit(cut_to))).drop("_g")


def portfolio_returns(held: DataFrame, date: str, ret: str) -> DataFrame:
    """``date, n_held, invested, port_ret``, before costs."""
    return held.groupBy(date).agg(F.count("*").alias("n_held"), F.sum("weight").alias("invested"), F.sum(F.col("weight") * F.col(ret)).alias("port_ret"))


def net_returns(held: DataFrame, by: str, date: str, ret: str, cost: float) -> DataFrame:
    """``date, n_held, invested, turnover, port_ret``: returns less ``cost`` a unit of what is bought and sold, the first purchase included.

    Only what changes costs: a portfolio that stays as it is pays nothing, and one that is swapped whole pays on both sides.
    """
    traded = turnover(held, by, date)
    r = portfolio_returns(held, date, ret).join(traded, date)
    return r.select(date, "n_held", "invested", "turnover", (F.col("port_ret") - 2 * cost * F.col("turnover")).alias("port_ret"))


def turnover(held: DataFrame, by: str, date: str) -> DataFrame:
    """Half the absolute change of weights from one date to the next. A name's exit is a weight of 0 on the date after its last."""
    days = held.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))
    own = held.join(days, date).select(by, "_i", "weight")
    # Each holding counts on its own date and, with opposite sign, on the next one.
    moves = own.union(own.select(by, F.col("_i") + 1, -F.col("weight"))).groupBy(by, "_i").agg(F.sum("weight").alias("_d"))
    return moves.groupBy("_i").agg((F.sum(F.abs("_d")) / 2).alias("turnover")).join(days, "_i").select(date, "turnover")


def summary(returns: DataFrame, by: list[str], date: str, ret: str, periods: int = PERIODS_A_YEAR) -> DataFrame:
    """Mean, volatility, Sharpe ratio, growth, largest drawdown and count of each strategy."""
    from tidemark.operators.bars import drawdown

    d = drawdown(returns, by, date, ret)
    return d.groupBy(*by).agg(
        F.count("*").alias("n_periods"), F.avg(ret).alias("mean_ret"), F.stddev_samp(ret).alias("vol"),
        (F.try_divide(F.avg(ret), F.nullif(F.stddev_samp(ret), F.lit(0.0))) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        F.max_by("wealth", date).alias("final_wealth"), F.min("drawdown").alias("max_drawdown"),
    )


def folds(dates: DataFrame, date: str, train: int, test: int, step: int | None = None) -> DataFrame:
    """``fold, train_from, train_to, test_from, test_to`` over the distinct dates in order; a test starts strictly after its training ends.

    The unpartitioned window sees one row per date.
    """
    step = step or test
    days = dates.select(date).distinct().withColumn("i", F.row_number().over(Window.orderBy(date)) - 1)
    spread = days.withColumn("fold", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.col("i") / step).cast("int")))))
    at = F.col("i") - F.col("fold") * step
    use = spread.withColumn("at", at).where((F.col("at") >= 0) & (F.col("at") < train + test))
    learn = F.col("at") < train
    out = use.groupBy("fold").agg(F.min(F.when(learn, F.col(date))).alias("train_from"), F.max(F.when(learn, F.col(date))).alias("train_to"), F.min(F.when(~learn, F.col(date))).alias("test_from"), F.max(F.when(~learn, F.col(date))).alias("test_to"), F.count(F.when(~learn, 1)).alias("n_test"))
    return out.where("n_test > 0")
