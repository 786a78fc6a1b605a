"""Evidence: abnormal returns against a model of the time before, errors by month, bootstrap draws, one-pass walk-forward books, stored sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as b, clustered, events as e, gram, portfolio as p, sketches, stories
from tidemark.plans import inputs as i
from tidemark.plans.books import HORIZON, best_of, features, panel
from tidemark.plans.news import _GROUPS
from tidemark.plans.registry import query
from tidemark.plans.study import AFTER, BEFORE
from tidemark.work import cut

FIT_ROWS = 24

_FIT = f"""
j as (select r.inst, r.month, r.ret, i.iret from rets r join idx i on i.month = r.month),
fit as (select *, regr_count(ret, iret) over w as fit_n, regr_slope(ret, iret) over w as beta, regr_intercept(ret, iret) over w as alpha from j
  window w as (partition by inst order by month rows between {FIT_ROWS + BEFORE} preceding and {BEFORE + 1} preceding))
"""


@query(f"""
with {_FIT},
cal as (select month, row_number() over (order by month) as idx from (select distinct month from bars)),
ev as (select v.news_id, v.inst, v.score, cal.idx, f.alpha, f.beta from evts v join cal on cal.month = v.month join fit f on f.inst = v.inst and f.month = v.month where f.fit_n >= 6 and f.beta is not null)
select ev.news_id, ev.inst, cast(c2.idx - ev.idx as int) as "offset", round(j.ret - ev.alpha - ev.beta * j.iret, 4) as ar
from ev join cal c2 on c2.idx between ev.idx - {BEFORE} and ev.idx + {AFTER} join j on j.inst = ev.inst and j.month = c2.month where j.ret is not null and j.iret is not null
""")
def abnormal_before_window(spark, sf):
    """Each event's window against the market model of the bars before that window."""
    j = i.returns(spark, sf).join(i.index(spark, sf), "month").select("inst", "month", "ret", "iret")
    fit = b.rolling_market_model(j, "inst", "month", "ret", "iret", FIT_ROWS, BEFORE).where("beta is not null").select("inst", "month", "alpha", "beta")
    ev = i.events_of(spark, sf).select("news_id", "inst", "month").join(fit, ["inst", "month"])
    w = e.event_window(ev, j.where("ret is not null and iret is not null"), e.trading_index(i.bars(spark, sf), "month"), "inst", "month", BEFORE, AFTER)
    ar = e.abnormal(F.col("ret"), F.col("iret"), F.col("alpha"), F.col("beta"))
    return w.select("news_id", "inst", F.col("offset").cast("int").alias("offset"), F.round(ar, 4).alias("ar"))


_SUMS = """
s as (select v.month, case when v.score < 0 then 'neg' when v.score > 0 then 'pos' else 'neu' end as class, sum(a.ar) as s, count(a.ar) as n
  from evts v join abn a on a.inst = v.inst and a.month = v.month where a.ar is not null group by 1, 2)
"""
DRAWS, SEED = 200, 1


def h2_sums(spark, sf):
    """Sums and counts of abnormal returns in the event's own month, by class and month."""
    w = i.events_of(spark, sf).join(i.abnormal_returns(spark, sf), ["inst", "month"])
    w = w.withColumn("class", F.when(F.col("score") < 0, "neg").when(F.col("score") > 0, "pos").otherwise("neu"))
    return clustered.cluster_sums(w, ["class"], "month", "ar")


@query(f"""
with {_SUMS}, t as (select class, sum(s) / sum(n) as mean, cast(sum(n) as bigint) as n, count(*) as n_clusters from s group by 1),
r as (select s.class, sum((s.s - s.n * t.mean) * (s.s - s.n * t.mean)) as q from s join t on t.class = s.class group by 1)
select class, round(mean, 6) as mean, round(sqrt(q * n_clusters / (n_clusters - 1)) / n, 6) as std_error, n, n_clusters, round(mean / (sqrt(q * n_clusters / (n_clusters - 1)) / n), 4) as t_stat from t join r using (class)
""")
def h2_clustered(spark, sf):
    """Events of one month count as one cluster: their returns share the month's shocks."""
    out = clustered.clustered_mean(h2_sums(spark, sf), ["class"])
    return out.select("class", F.round("mean", 6).alias("mean"), F.round("std_error", 6).alias("std_error"), "n", "n_clusters", F.round("t_stat", 4).alias("t_stat"))


_WEIGHT = " + ".join(f"cast(u > {p!r} as int)" for p in clustered.poisson_steps())


@query(f"""
with {_SUMS}, d as (select *, cast(concat('0x', left(md5('{SEED}:' || cast(month as varchar) || ':' || draw), 8)) as bigint) / 4294967296.0e0 as u from s, (select unnest(range(0, {DRAWS})) as draw)),
w as (select *, {_WEIGHT} as w from d), m as (select class, draw, sum(w * s) / sum(w * n) as mean from w where w > 0 group by 1, 2)
select class, count(*) as n_draws, round(avg(mean), 6) as mean, round(stddev_samp(mean), 6) as std_error, round(quantile_disc(mean, 0.025), 6) as low, round(quantile_disc(mean, 0.975), 6) as high from m group by 1
""")
def h2_bootstrap(spark, sf):
    """Means of H2's classes over draws of whole months, with a central interval of 95 %."""
    draws = clustered.bootstrap(h2_sums(spark, sf), ["class"], "month", DRAWS, SEED)
    at = lambda q: F.round(F.expr(f"percentile_disc({q}) within group (order by mean)"), 6)
    return draws.groupBy("class").agg(F.count("*").alias("n_draws"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.stddev_samp("mean"), 6).alias("std_error"), at(0.025).alias("low"), at(0.975).alias("high"))


TRAIN, TEST = 36, 12


@query()
def m0_ridge(spark, sf):
    """A linear book over M1's features: one pass over the panel for all folds. The slope of one feature is held against SQL in ``m0_slope``."""
    x = cut(features(spark, sf).where("fwd is not null"), "features")
    names = [c for c in x.columns if c not in ("inst", "month", "fwd")]
    scored = gram.walk_forward(x, p.folds(x, "month", TRAIN, TEST), "month", names, "fwd", horizon=HORIZON)
    return p.portfolio_returns(p.equal_weights(best_of(scored.select("inst", "month", "fwd", "score")), "month"), "month", "fwd")


@query(f"""
with x as (select r.inst, r.month, r.hold as fwd, s.s from rets r join (select inst, month, avg(score) as s from evts group by 1, 2) s on s.inst = r.inst and s.month = r.month where r.hold is not null),
m as (select month, row_number() over (order by month) - 1 as i from (select distinct month from x)),
f as (select unnest(range(0, (select count(*) from m))) as fold),
t as (select cast(fold as int) as fold, min(case when i < fold * {TEST} + {TRAIN} then month end) as train_from, min(case when i >= fold * {TEST} + {TRAIN} then month end) as test_from, max(month) as test_to
  from f join m on i >= fold * {TEST} and i < fold * {TEST} + {TRAIN + TEST} group by fold having count(case when i >= fold * {TEST} + {TRAIN} then 1 end) > 0),
k as (select t.*, (select month from m where m.i = (select i from m where m.month = t.test_from) - {HORIZON}) as until from t)
select fold, count(*) as n, round(regr_intercept(fwd, s), 5) as intercept, round(regr_slope(fwd, s), 5) as slope from k join x on x.month >= k.train_from and x.month < k.until group by fold
""")
def m0_slope(spark, sf):
    """Each fold's regression on sentiment alone, out of the months' sums."""
    x = panel(spark, sf)
    w = gram.fold_weights(x, p.folds(x, "month", TRAIN, TEST), "month", ["s"], "fwd", 0.0, HORIZON)
    return w.select("fold", "n", F.round(F.get("w", F.lit(0)), 5).alias("intercept"), F.round(F.get("w", F.lit(1)), 5).alias("slope"))


THETA_BITS = 14  # a shard's sketch of up to 16,384 different stories counts them exactly; beyond, within 3 / 128 nearly always


@query(f"""
with {_GROUPS}, seen as (select cluster_id, max(kind = 'tg') as tg, max(kind = 'media') as media from g group by 1)
select 'tg' as part, count(*) filter (tg) as n, count(*) filter (tg) as about from seen union all select 'media', count(*) filter (media), count(*) filter (media) from seen
union all select 'both', count(*) filter (tg and media), count(*) filter (tg and media) from seen union all select 'either', count(*), count(*) from seen
""")
def coverage_sketches(spark, sf):
    """Stories by kind from sketches kept by month: merged over months, then intersected and united; the exact count beside each. Sketches are sharded, so both are equal to some 14 million stories."""
    g = stories.exact_groups(i.news(spark, sf), "news_id", "text").select("kind", "month", "cluster_id")
    kept = cut(sketches.by_period(g, ["kind", "month"], "cluster_id", THETA_BITS), "sketches")
    about = sketches.compared(kept, "kind", "tg", "media", THETA_BITS)
    seen = g.groupBy("cluster_id").agg(F.max((F.col("kind") == "tg").cast("int")).alias("tg"), F.max((F.col("kind") == "media").cast("int")).alias("media"))
    exact = seen.agg(F.sum("tg").alias("tg"), F.sum("media").alias("media"), F.sum(F.col("tg") * F.col("media")).alias("both"), F.count("*").alias("either"))
    exact = exact.select(F.explode(F.create_map(*(x for name in exact.columns for x in (F.lit(name), F.col(name))))).alias("part", "n"))
    return exact.join(about, "part").select("part", "n", "about")
