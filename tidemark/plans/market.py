"""Market data: bars, returns, windows, as-of joins, market model, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, bars as b, events, portfolio, ranks
from tidemark.plans import inputs as i
from tidemark.plans.registry import query
from tidemark.streaming import quotes, windows
from tidemark.work import fresh


def money(column: str, name: str | None = None):
    """Four digits; exact halves, which prices out of whole cents and quantities often are, go up in every engine."""
    return F.round(F.col(column) + 1e-7, 4).alias(name or column)


@query("""
with spot as (select inst, d, sum(px * qty) / sum(qty) as p, max(px) as h, min(px) as l, sum(qty) as v, sum(px * qty) as n from trades group by 1, 2)
select inst, cast(date_trunc('month', d) as date) as period, round(min_by(p, d) + 1e-7, 4) as open, round(max(h) + 1e-7, 4) as high, round(min(l) + 1e-7, 4) as low,
       round(max_by(p, d) + 1e-7, 4) as close, sum(v) as volume, round(sum(n) / sum(v) + 1e-7, 4) as vwap
from spot group by 1, 2
""")
def ohlcv_monthly(spark, sf):
    out = b.resample(i.trades(spark, sf), "inst", "d", "px", "qty", "month")
    return out.select("inst", "period", *map(money, ("open", "high", "low", "close")), "volume", money("vwap"))


@query("select inst, month, round(px + 1e-7, 4) as px, round(ret, 6) as ret, round(log_ret, 6) as log_ret, round(fwd, 6) as fwd from rets")
def returns_lag_lead(spark, sf):
    return i.returns(spark, sf).select("inst", "month", money("px"), *(F.round(c, 6).alias(c) for c in ("ret", "log_ret", "fwd")))


@query("""
select inst, month, round(avg(ret) over w, 6) as roll_mean, round(stddev_samp(ret) over w, 6) as roll_std, count(ret) over w as roll_n
from rets window w as (partition by inst order by month rows between 2 preceding and current row)
""")
def rolling_stats(spark, sf):
    r = b.rolling(i.returns(spark, sf), "inst", "month", "ret", 3)
    return r.select("inst", "month", F.round("roll_mean", 6).alias("roll_mean"), F.round("roll_std", 6).alias("roll_std"), "roll_n")


@query("select inst, month, round(avg(ret) over w, 6) as span_mean, count(ret) over w as span_n from rets window w as (partition by inst order by date_diff('day', date '1970-01-01', month) range between 89 preceding and current row)")
def rolling_days(spark, sf):
    """Over ninety days, not a number of bars: months without a bar shorten it."""
    r = b.rolling_days(i.returns(spark, sf), "inst", "month", "ret", 90)
    return r.select("inst", "month", F.round("span_mean", 6).alias("span_mean"), "span_n")


@query("""
with fit as (select inst, regr_slope(ret, iret) as beta, regr_intercept(ret, iret) as alpha from rets r join idx i on i.month = r.month where ret is not null and iret is not null group by inst having count(*) >= 3)
select r.inst, r.month, round(r.ret - alpha - beta * i.iret, 4) as ar from rets r join idx i on i.month = r.month join fit on fit.inst = r.inst where beta is not null
""")
def abnormal_by_market_model(spark, sf):
    """Residuals of each security's market model."""
    j = i.returns(spark, sf).join(i.index(spark, sf), "month")
    fit = b.market_model(j, "inst", "ret", "iret").where("n >= 3 and beta is not null").select("inst", "alpha", "beta")
    ar = events.abnormal(F.col("ret"), F.col("iret"), F.col("alpha"), F.col("beta"))
    return j.join(fit, "inst").select("inst", "month", F.round(ar, 4).alias("ar"))


@query("""
with g as (select inst, month, exp(sum(ln(1 + coalesce(ret, 0))) over (partition by inst order by month)) as wealth from rets),
p as (select *, greatest(1.0e0, max(wealth) over (partition by inst order by month)) as peak from g)
select inst, month, round(wealth, 6) as wealth, round(peak, 6) as peak, round(wealth / peak - 1, 6) as drawdown from p
""")
def drawdown(spark, sf):
    d = b.drawdown(i.returns(spark, sf), ["inst"], "month", "ret")
    return d.select("inst", "month", *(F.round(c, 6).alias(c) for c in ("wealth", "peak", "drawdown")))


@query("""
with m as (select distinct month from bars), k as (select distinct inst from bars),
r as (select k.inst, m.month, x.px from m, k left join bars x on x.inst = k.inst and x.month = m.month)
select inst, month, round(last_value(px ignore nulls) over (partition by inst order by month) + 1e-7, 4) as px from r
""")
def gap_fill(spark, sf):
    """Every month for each instrument; the grid is the calendar's list of months exploded, not a cross join."""
    x = i.bars(spark, sf)
    months = sorted(r.month for r in x.select("month").distinct().collect())  # a calendar: bounded by time, not by data
    grid = x.select("inst").distinct().withColumn("month", F.explode(F.array(*map(F.lit, months)).cast("array<date>")))
    return asof.gap_fill(grid, x, ["inst"], "month", ["px"]).select("inst", "month", money("px"))


@query("select r.month, round(i.ipx + 1e-7, 4) as ipx, round(i.iret, 6) as iret, count(*) as n_inst, round(avg(r.ret), 6) as mean_ret from rets r join idx i on i.month = r.month group by r.month, i.ipx, i.iret")
def index_join(spark, sf):
    j = i.returns(spark, sf).join(i.index(spark, sf), "month")
    return j.groupBy("month", "ipx", "iret").agg(F.count("*").alias("n_inst"), F.round(F.avg("ret"), 6).alias("mean_ret")).select("month", money("ipx"), F.round("iret", 6).alias("iret"), "n_inst", "mean_ret")


@query("""
select inst, round(regr_slope(ret, iret), 4) as beta, round(regr_intercept(ret, iret), 4) as alpha, round(corr(ret, iret), 4) as corr, count(*) as n
from rets r join idx i on i.month = r.month where ret is not null and iret is not null group by inst having count(*) >= 3
""")
def market_model_beta(spark, sf):
    j = i.returns(spark, sf).join(i.index(spark, sf), "month")
    return b.market_model(j, "inst", "ret", "iret").where("n >= 3").select("inst", *(F.round(c, 4).alias(c) for c in ("beta", "alpha", "corr")), "n")


_QUOTES = "q as (select inst, d, sum(px * qty) / sum(qty) as vwap from trades group by 1, 2), e as (select distinct m.news_id, m.inst, cast(s.published as date) as d from mentioned m join stories s on s.news_id = m.news_id)"


def _asof_inputs(spark, sf):
    t = i.trades(spark, sf)
    quotes = t.groupBy("inst", "d").agg((F.sum(F.col("px") * F.col("qty")) / F.sum("qty")).alias("vwap"))
    e = i.mentions(spark, sf).join(i.news(spark, sf).select("news_id", F.col("published").cast("date").alias("d")), "news_id")
    return e, quotes


def _asof(spark, sf, **how):
    e, quotes = _asof_inputs(spark, sf)
    out = asof.asof_join(e, quotes, ["inst"], "d", "d", ["vwap"], **how)
    return out.select("news_id", "inst", "d", F.col("asof_d").alias("quote_d"), money("asof_vwap", "vwap"))


@query(f"with {_QUOTES} select e.news_id, e.inst, e.d, q.d as quote_d, round(q.vwap + 1e-7, 4) as vwap from e asof left join q on q.inst = e.inst and q.d <= e.d")
def asof_backward(spark, sf):
    return _asof(spark, sf)


@query(f"with {_QUOTES} select e.news_id, e.inst, e.d, q.d as quote_d, round(q.vwap + 1e-7, 4) as vwap from e asof left join q on q.inst = e.inst and q.d >= e.d")
def asof_forward(spark, sf):
    return _asof(spark, sf, direction="forward")


@query(f"with {_QUOTES} select e.news_id, e.inst, e.d, q.d as quote_d, round(q.vwap + 1e-7, 4) as vwap from e asof left join q on q.inst = e.inst and q.d > e.d")
def asof_forward_strict(spark, sf):
    """The next quote strictly after publication: what a decision may trade on."""
    return _asof(spark, sf, direction="forward", strict=True)


@query(f"with {_QUOTES} select e.news_id, e.inst, e.d, q.d as quote_d, round(q.vwap + 1e-7, 4) as vwap from e asof left join q on q.inst = e.inst and q.d < e.d")
def asof_backward_strict(spark, sf):
    return _asof(spark, sf, strict=True)


@query(f"""
with {_QUOTES}, w as (select least((select max(d) from e), (select max(d) from q)) - interval 1 hour as mark)
select e.news_id, e.inst, e.d, q.d as quote_d, round(q.vwap + 1e-7, 4) as vwap from e asof left join q on q.inst = e.inst and q.d <= e.d where e.d < (select mark from w)
""")
def stream_asof(spark, sf):
    """The same join as two streams, by state and timers: news come out once both streams have passed them, so those of the last day wait."""
    e, q = _asof_inputs(spark, sf)
    inputs = []
    for df, name in ((e, "stream-news"), (q, "stream-quotes")):
        path = fresh(spark, name)
        df.withColumn("d", F.col("d").cast("timestamp")).write.parquet(path)
        inputs.append(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    with quotes.rocksdb(spark):
        out = windows.drain(quotes.asof_stream(*inputs, "inst", "news_id", "d", "d", "vwap", "1 hour"), "stream-asof")
    return out.select("news_id", "inst", F.col("d").cast("date").alias("d"), F.col("asof_d").cast("date").alias("quote_d"), money("asof_vwap", "vwap"))


@query("""
with r as (select distinct cast(date_trunc('quarter', d) as date) as from_d from trades),
rate as (select from_d, cast(5 + (month(from_d) + year(from_d)) % 7 as double) as rate from r), p as (select distinct inst, month from bars)
select p.inst, p.month, rate.rate from p asof left join rate on rate.from_d <= p.month
""")
def step_series_rate(spark, sf):
    """A step function (a rate by its effective date) on the panel's months; every instrument shares one series, so the join runs on the months alone."""
    r = i.trades(spark, sf).select(F.date_trunc("quarter", "d").cast("date").alias("from_d")).distinct()
    rate = r.select("from_d", (5 + (F.month("from_d") + F.year("from_d")) % 7).cast("double").alias("rate"), F.lit(1).alias("k"))
    months = i.bars(spark, sf).select("month", F.lit(1).alias("k")).distinct()
    by_month = asof.asof_join(months, rate, ["k"], "month", "from_d", ["rate"]).select("month", F.col("asof_rate").alias("rate"))
    return i.bars(spark, sf).select("inst", "month").distinct().join(by_month, "month").select("inst", "month", "rate")


@query("""
select inst, name, round(cap, 2) as cap, cast(ntile(5) over (order by cap, inst) as int) as bucket, round(percent_rank() over (order by cap), 6) as pct from dim
""")
def cap_bucket(spark, sf):
    """Size buckets. Ranking is global by meaning; ranges of it are numbered side by side."""
    ranked = ranks.percent_rank(ranks.number_rows(i.dimension(spark, sf), ["cap", "inst"], "caps"), "cap", "pct")
    return ranked.select("inst", "name", F.round("cap", 2).alias("cap"), ranks.bucket_of(F.col("row_no"), F.col("n_rows"), 5).alias("bucket"), F.round("pct", 6).alias("pct"))


@query("""
with m as (select month, row_number() over (order by month) - 1 as i from (select distinct month from bars)),
f as (select fold * 6 as start, fold from (select unnest(range(0, (select count(*) from m))) as fold)),
u as (select f.fold, m.month, m.i - f.start as place from f join m on m.i >= f.start and m.i < f.start + 18)
select cast(fold as int) as fold, min(case when place < 12 then month end) as train_from, max(case when place < 12 then month end) as train_to, min(case when place >= 12 then month end) as test_from,
       max(case when place >= 12 then month end) as test_to, count(case when place >= 12 then 1 end) as n_test
from u group by fold having count(case when place >= 12 then 1 end) > 0
""")
def walk_forward_folds(spark, sf):
    return portfolio.folds(i.bars(spark, sf), "month", 12, 6)


@query("select l_suppkey as inst, cast(date_trunc('week', l_shipdate) as date) as week, cast(dayofweek(l_shipdate) + 1 as int) as weekday, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by 1, 2, 3")
def calendar_truncation(spark, sf):
    t = i.table(spark, sf, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("inst"), F.date_trunc("week", "l_shipdate").cast("date").alias("week"), F.dayofweek("l_shipdate").alias("weekday")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""
select market, sector, count(distinct inst) as n_inst, round(sum(volume), 2) as volume, cast(grouping(market) * 2 + grouping(sector) as int) as level
from bars join dim using (inst) group by rollup (market, sector)
""")
def sector_rollup(spark, sf):
    j = i.bars(spark, sf).join(i.dimension(spark, sf), "inst")
    return j.rollup("market", "sector").agg(F.count_distinct("inst").alias("n_inst"), F.round(F.sum("volume"), 2).alias("volume"), F.grouping_id().cast("int").alias("level"))


@query("select market, cast(year(month) as int) as year, round(sum(volume), 2) as volume, cast(grouping(market) * 2 + grouping(year(month)) as int) as level from bars join dim using (inst) group by cube (market, year(month))")
def market_year_cube(spark, sf):
    j = i.bars(spark, sf).join(i.dimension(spark, sf), "inst").withColumn("year", F.year("month"))
    return j.cube("market", "year").agg(F.round(F.sum("volume"), 2).alias("volume"), F.grouping_id().cast("int").alias("level"))
