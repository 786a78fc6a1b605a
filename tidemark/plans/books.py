"""Portfolios: feature panel, the sentiment rule, learned scores, weights, cash gate, reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.operators import asof, macro, portfolio as p, sentiment
from tidemark.plans import inputs as i
from tidemark.plans.news import SCOPES
from tidemark.plans.registry import query
from tidemark.work import cut

_SENT = "sent as (select inst, month, count(*) as n_news, avg(score) as s from evts group by 1, 2)"
_RANKED = f"{_SENT}, ranked as (select r.month, r.inst, r.hold as fwd, s.s, s.n_news, row_number() over (partition by r.month order by s.s desc, s.n_news desc, r.inst) as rank from rets r join sent s on s.inst = r.inst and s.month = r.month where r.hold is not null)"


def panel(spark, sf):
    """``inst, month, fwd, s, n_news``: months with news and two bars after. ``fwd`` is bought at the next month's price, all of it traded after the news."""
    s = i.events_of(spark, sf).groupBy("inst", "month").agg(F.count("*").alias("n_news"), F.avg("score").alias("s"))
    return i.returns(spark, sf).where("hold is not null").select("inst", "month", F.col("hold").alias("fwd")).join(s, ["inst", "month"])


def held(spark, sf):
    return p.top_k(panel(spark, sf), "month", [F.desc("s"), F.desc("n_news"), F.col("inst")])


@query(f"with {_RANKED} select month, count(*) as n_held, round(avg(fwd), 4) as port_ret from ranked where rank <= 5 and s > 0 group by month")
def v1_portfolio(spark, sf):
    """The sentiment rule: each month the five best-rated securities with positive sentiment, equal weights."""
    h = p.equal_weights(held(spark, sf).where("s > 0"), "month")
    return p.portfolio_returns(h, "month", "fwd").select("month", "n_held", F.round("port_ret", 4).alias("port_ret"))


@query(f"with {_RANKED} select month, inst, cast(rank as int) as rank, n_news, round(s, 6) as s from ranked where rank <= 5")
def topk_per_date(spark, sf):
    return held(spark, sf).select("month", "inst", "rank", "n_news", F.round("s", 6).alias("s"))


@query(f"with {_RANKED} select month, inst, round(exp(s) / sum(exp(s)) over (partition by month), 6) as weight from ranked where rank <= 5")
def softmax_weights(spark, sf):
    return p.softmax_weights(held(spark, sf), "month", "s").select("month", "inst", F.round("weight", 6).alias("weight"))


_GATED = f"""{_RANKED},
w as (select month, inst, fwd, exp(s) / sum(exp(s)) over (partition by month) as weight from ranked where rank <= 5),
gate as (select month, lag(ipx) over (order by month) as before, lag(ipx, 2) over (order by month) as before2 from idx),
c as (select w.month, w.inst, w.fwd, w.weight * case when gate.before >= gate.before2 then 1.0e0 else 0.0e0 end as weight from w left join gate on gate.month = w.month)
"""


def gated(spark, sf, h=None):
    """Out to cash unless the index rose over the month before: strictly past information. ``h`` is what is held, if it is known already."""
    w = Window.orderBy("month")  # over the index: one row a month
    gate = i.index(spark, sf).withColumn("before", F.lag("ipx").over(w)).withColumn("before2", F.lag("ipx", 2).over(w))
    return p.cash_exit(p.softmax_weights(h or held(spark, sf), "month", "s"), gate, "month", F.col("before") >= F.col("before2"))


@query(f"with {_GATED} select month, count(*) as n_held, round(sum(weight), 6) as invested, round(1 - sum(weight), 6) as cash, round(sum(weight * fwd), 6) as port_ret from c group by month")
def cash_exit(spark, sf):
    r = p.portfolio_returns(gated(spark, sf), "month", "fwd")
    return r.select("month", "n_held", F.round("invested", 6).alias("invested"), F.round(1 - F.col("invested"), 6).alias("cash"), F.round("port_ret", 6).alias("port_ret"))


_SERIES = f"""{_GATED},
series as (select 'v1' as strategy, month, avg(fwd) as r from ranked where rank <= 5 and s > 0 group by month
  union all select 'softmax', month, sum(weight * fwd) from w group by month union all select 'cash', month, sum(weight * fwd) from c group by month),
wealth as (select *, exp(sum(ln(1 + r)) over (partition by strategy order by month)) as wealth from series),
dd as (select *, wealth / greatest(1.0e0, max(wealth) over (partition by strategy order by month)) - 1 as dd from wealth)
"""


@query(f"""
with {_SERIES} select strategy, count(*) as n_periods, round(avg(r), 6) as mean_ret, round(stddev_samp(r), 6) as vol, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12), 4) as sharpe,
  round(max_by(wealth, month), 4) as final_wealth, round(min(dd), 6) as max_drawdown from dd group by strategy
""")
def backtest_summary(spark, sf):
    h, soft = cut(held(spark, sf), "held"), lambda x: p.softmax_weights(x, "month", "s")
    named = lambda df, name: p.portfolio_returns(df, "month", "fwd").select(F.lit(name).alias("strategy"), "month", "port_ret")
    series = named(p.equal_weights(h.where("s > 0"), "month"), "v1").unionByName(named(soft(h), "softmax")).unionByName(named(gated(spark, sf, h), "cash"))
    out = p.summary(series, ["strategy"], "month", "port_ret")
    return out.select("strategy", "n_periods", F.round("mean_ret", 6).alias("mean_ret"), F.round("vol", 6).alias("vol"), F.round("sharpe", 4).alias("sharpe"), F.round("final_wealth", 4).alias("final_wealth"), F.round("max_drawdown", 6).alias("max_drawdown"))


@query(f"""
with {_RANKED}, w as (select month, inst, 1.0e0 / count(*) over (partition by month) as weight from ranked where rank <= 5),
days as (select month, row_number() over (order by month) as i from (select distinct month from w)),
o as (select inst, i, weight from w join days using (month)),
d as (select inst, i, sum(weight) as d from (select * from o union all select inst, i + 1, -weight from o) group by 1, 2)
select days.month, round(sum(abs(d)) / 2, 6) as turnover from d join days using (i) group by 1
""")
def turnover(spark, sf):
    return p.turnover(p.equal_weights(held(spark, sf), "month"), "inst", "month").select("month", F.round("turnover", 6).alias("turnover"))


def features(spark, sf):
    """The learners' panel: past returns, volatility, own sentiment, that of macro news by sector and market; ``fwd``, bought at the next month's price, is the target."""
    r = i.returns(spark, sf).withColumn("fwd", F.col("hold"))
    w = Window.partitionBy("inst").orderBy("month")
    r = r.withColumn("ret_1", F.coalesce("ret", F.lit(0.0))).withColumn("vol_3", F.coalesce(F.stddev_samp("ret").over(w.rowsBetween(-2, 0)), F.lit(0.0)))
    dim = i.dimension(spark, sf).select("inst", "sector")
    ev = i.events_of(spark, sf)
    own = sentiment.aggregate(ev, ["inst", "month"], "score").select("inst", "month", "sent", "n_news")
    market, sector = macro.by_scope(i.signalled(spark, sf), "month", "score")
    x = r.join(dim, "inst").join(own, ["inst", "month"], "left").fillna(0, ["sent", "n_news"])
    x = sentiment.spread_scopes(x, market, sector, "month", "sector").join(i.index(spark, sf).select("month", F.coalesce("iret", F.lit(0.0)).alias("iret")), "month")
    return x.select("inst", "month", "fwd", "ret_1", "vol_3", "sent", F.col("n_news").cast("double").alias("n_news"), "market_sent", "sector_sent", "iret")


@query(f"""
with own as (select inst, month, avg(score) as sent, count(score) as n_news from evts group by 1, 2), {SCOPES}
select r.inst, r.month, round(r.hold, 6) as fwd, round(coalesce(r.ret, 0), 6) as ret_1,
       round(coalesce(stddev_samp(r.ret) over (partition by r.inst order by r.month rows between 2 preceding and current row), 0), 6) as vol_3,
       round(coalesce(own.sent, 0), 6) as sent, cast(coalesce(own.n_news, 0) as double) as n_news, round(coalesce(ms.sent, 0), 6) as market_sent, round(coalesce(ss.sent, 0), 6) as sector_sent, round(coalesce(idx.iret, 0), 6) as iret
from rets r join dim on dim.inst = r.inst join idx on idx.month = r.month left join own on own.inst = r.inst and own.month = r.month
left join ms on ms.month = r.month left join ss on ss.month = r.month and ss.sector = dim.sector
""")
def feature_panel(spark, sf):
    f = features(spark, sf)
    return f.select("inst", "month", *(F.round(c, 6).alias(c) for c in f.columns[2:]))


def extended_features(spark, sf, x=None):
    """``features``, or ``x`` in their place, with ``brent_ret``, the commodity's last move, and ``div_yield``, the last dividend over the price; both known before the month begins.

    Stand-ins: the commodity's price is the mean order of a month, dividends are the tax of a security's returned items.
    """
    o = i.table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("at")).agg(F.avg("o_totalprice").alias("price"))
    # One row a month, and one series for all securities: joined on the months alone.
    moves = o.select("at", F.lit(1).alias("k"), (F.col("price") / F.lag("price").over(Window.orderBy("at")) - 1).alias("brent_ret"))
    x, bars = features(spark, sf) if x is None else x, i.bars(spark, sf)
    months = bars.select("month", F.lit(1).alias("k")).distinct()
    brent = asof.asof_join(months, moves, ["k"], "month", "at", ["brent_ret"], strict=True).select("month", F.coalesce("asof_brent_ret", F.lit(0.0)).alias("brent_ret"))
    paid = i.table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 0").groupBy(F.col("l_suppkey").alias("inst"), F.date_trunc("month", "l_shipdate").cast("date").alias("at"))
    dividends = paid.agg((F.sum(F.col("l_extendedprice") * F.col("l_tax")) / F.sum("l_quantity")).alias("amount"))
    yields = asof.asof_join(bars.select("inst", "month", "px"), dividends, ["inst"], "month", "at", ["amount"], strict=True)
    yields = yields.select("inst", "month", F.coalesce(F.col("asof_amount") / F.col("px"), F.lit(0.0)).alias("div_yield"))
    return x.join(yields, ["inst", "month"]).join(brent, "month").select(*x.columns, "brent_ret", "div_yield")


@query("""
with c as (select cast(date_trunc('month', o_orderdate) as date) as since, avg(o_totalprice) as price from orders group by 1),
cr as (select since, price / lag(price) over (order by since) - 1 as brent_ret from c),
dv as (select l_suppkey as inst, cast(date_trunc('month', l_shipdate) as date) as since, sum(l_extendedprice * l_tax) / sum(l_quantity) as amount from lineitem where l_returnflag = 'R' and l_quantity > 0 group by 1, 2)
select r.inst, r.month, round(coalesce(cr.brent_ret, 0), 6) as brent_ret, round(coalesce(dv.amount / r.px, 0), 6) as div_yield
from rets r asof left join cr on cr.since < r.month asof left join dv on dv.inst = r.inst and dv.since < r.month
""")
def m3_features(spark, sf):
    """What M3 sees beyond M1 and M2."""
    return extended_features(spark, sf).select("inst", "month", F.round("brent_ret", 6).alias("brent_ret"), F.round("div_yield", 6).alias("div_yield"))


HORIZON = 2  # months after its own that a target reaches into


def walk_forward(x, train: int = 36, test: int = 12):
    """Walk-forward predictions ``inst, month, fwd, score`` by gradient-boosted trees over a panel ``inst, month, fwd`` and features: each fold learns strictly before it predicts.

    The loop runs over folds, whose number the calendar bounds; each fit is distributed.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = cut(x.where("fwd is not null"), "features")
    names = [c for c in x.columns if c not in ("inst", "month", "fwd")]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(x)
    months = sorted(r.month for r in x.select("month").distinct().collect())  # a calendar: bounded by time, not by data
    out = []
    for f in p.folds(x, "month", train, test).orderBy("fold").collect():
        # A target that ends within the test is not known when the test begins.
        known = months[max(0, months.index(f.test_from) - HORIZON)]
        learn = data.where((F.col("month") >= F.lit(f.train_from)) & (F.col("month") < F.lit(known)))
        model = GBTRegressor(labelCol="fwd", maxIter=5, maxDepth=3, seed=7).fit(learn)
        ahead = data.where((F.col("month") >= F.lit(f.test_from)) & (F.col("month") <= F.lit(f.test_to)))
        out.append(model.transform(ahead).select("inst", "month", "fwd", F.col("prediction").alias("score")))
    if not out:
        return x.select("inst", "month", "fwd", F.lit(None).cast("double").alias("score")).limit(0)
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def best_of(scores):
    return p.top_k(scores, "month", [F.desc("score"), F.col("inst")])


def m1(scores):
    """Learned scores, top k, equal weights."""
    return p.equal_weights(best_of(scores), "month")


def m2(scores):
    """M1 with softmax weights."""
    return p.softmax_weights(best_of(scores), "month", "score", 0.1)


def m3(scores, index):
    """M2 with the cash gate on past index moves; its scores are to see the extended features."""
    w = Window.orderBy("month")  # over the index: one row a month
    gate = index.withColumn("before", F.lag("ipx").over(w)).withColumn("before2", F.lag("ipx", 2).over(w))
    return p.cash_exit(m2(scores), gate, "month", F.col("before") >= F.col("before2"))


@query()
def m1_gbt(spark, sf):
    """M1. Tree fits are beyond SQL; a panel made by hand tests them."""
    return p.portfolio_returns(m1(walk_forward(features(spark, sf))), "month", "fwd")


@query()
def m2_softmax(spark, sf):
    return p.portfolio_returns(m2(walk_forward(features(spark, sf))), "month", "fwd")


@query()
def m3_cash(spark, sf):
    """M3: M2 with the commodity's and the dividends' features, and the cash gate."""
    return p.portfolio_returns(m3(walk_forward(extended_features(spark, sf)), i.index(spark, sf)), "month", "fwd")


COST = 0.001


@query(f"""
with {_RANKED}, w as (select month, inst, fwd, 1.0e0 / count(*) over (partition by month) as weight from ranked where rank <= 5 and s > 0),
days as (select month, row_number() over (order by month) as i from (select distinct month from w)),
o as (select inst, i, weight from w join days using (month)),
d as (select inst, i, sum(weight) as d from (select * from o union all select inst, i + 1, -weight from o) group by 1, 2),
t as (select days.month, sum(abs(d)) / 2 as turnover from d join days using (i) group by 1)
select w.month, count(*) as n_held, round(any_value(t.turnover), 6) as turnover, round(sum(weight * fwd), 6) as gross, round(sum(weight * fwd) - 2 * 0.001 * any_value(t.turnover), 6) as net from w join t on t.month = w.month group by w.month
""")
def v1_net(spark, sf):
    """The sentiment rule after a tenth of a per cent on all that is bought and sold."""
    h = cut(p.equal_weights(held(spark, sf).where("s > 0"), "month"), "held")
    net = p.net_returns(h, "inst", "month", "fwd", COST)
    return net.select("month", "n_held", F.round("turnover", 6).alias("turnover"), F.round(F.col("port_ret") + 2 * COST * F.col("turnover"), 6).alias("gross"), F.round("port_ret", 6).alias("net"))


@query()
def backtest_models(spark, sf):
    """Reports of M1, M2 and M3 before and after costs."""
    x = cut(features(spark, sf), "panel")  # once for all models: it reads trades and news
    plain, wide = cut(walk_forward(x), "scores"), cut(walk_forward(extended_features(spark, sf, x)), "scores")
    books = {"m1": m1(plain), "m2": m2(plain), "m3": m3(wide, i.index(spark, sf))}
    series = None
    for name, book in books.items():
        book = cut(book.select("inst", "month", "fwd", "weight"), "book")
        for costs, rows in (("gross", p.portfolio_returns(book, "month", "fwd")), ("net", p.net_returns(book, "inst", "month", "fwd", COST))):
            one = rows.select(F.lit(name).alias("strategy"), F.lit(costs).alias("costs"), "month", "port_ret")
            series = one if series is None else series.unionByName(one)
    return p.summary(series, ["strategy", "costs"], "month", "port_ret")
