"""Event study: windows, abnormal returns and the four hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.money import t_statistic
from tidemark.operators import events as e, ranks, stories
from tidemark.plans import inputs as i
from tidemark.plans.news import _GROUPS
from tidemark.plans.registry import query

BEFORE, AFTER = 2, 2
_WINDOW = """
cal as (select month, row_number() over (order by month) as idx from (select distinct month from bars)),
ev as (select news_id, inst, score, idx from evts join cal using (month)),
win as (select ev.news_id, ev.inst, ev.score, c2.idx - ev.idx as off, a.ar from ev join cal c2 on c2.idx between ev.idx - 2 and ev.idx + 2 join abn a on a.inst = ev.inst and a.month = c2.month)
"""
_STATS = "round(avg({0}), 6) as mean_ar, round(stddev_samp({0}), 6) as std_ar, count({0}) as n, round(avg({0}) / (nullif(stddev_samp({0}), 0) / sqrt(count({0}))), 4) as t_stat"


def windows(spark, sf):
    ev = i.events_of(spark, sf).select("news_id", "inst", "month", "score")
    return e.event_window(ev, i.abnormal_returns(spark, sf), e.trading_index(i.bars(spark, sf), "month"), "inst", "month", BEFORE, AFTER)


def stats(df, *groups):
    out = e.mean_abnormal(df, list(groups), "ar")
    return out.select(*groups, F.round("mean_ar", 6).alias("mean_ar"), F.round("std_ar", 6).alias("std_ar"), "n", F.round("t_stat", 4).alias("t_stat"))


@query(f"with {_WINDOW} select cast(off as int) as \"offset\", count(*) as n_rows, count(ar) as n, round(avg(ar), 6) as mean_ar from win group by off")
def event_window(spark, sf):
    return windows(spark, sf).groupBy("offset").agg(F.count("*").alias("n_rows"), F.count("ar").alias("n"), F.round(F.avg("ar"), 6).alias("mean_ar")).select(F.col("offset").cast("int").alias("offset"), "n_rows", "n", "mean_ar")


@query(f"""
with {_WINDOW} select news_id, inst, cast(off as int) as "offset", round(sum(ar) over (partition by news_id, inst order by off rows unbounded preceding), 6) as car from win where ar is not null
""")
def cumulative_abnormal(spark, sf):
    w = e.cumulative(windows(spark, sf).where("ar is not null"), ["news_id", "inst"], "ar")
    return w.select("news_id", "inst", F.col("offset").cast("int").alias("offset"), F.round("car", 6).alias("car"))


@query(f"""
with {_GROUPS}, t as (select cluster_id, min(case when kind = 'tg' then published end) as a, min(case when kind = 'media' then published end) as b from g group by 1),
m as (select date_diff('second', a, b) / 60.0 as lead_minutes from t where a is not null and b is not null)
select count(*) as n, round(avg(lead_minutes), 4) as mean_lead, round(avg(lead_minutes) / (nullif(stddev_samp(lead_minutes), 0) / sqrt(count(lead_minutes))), 4) as t_stat,
       cast(coalesce(sum(case when lead_minutes > 0 then 1 else 0 end), 0) as bigint) as n_leads from m
""")
def h1_lead_time(spark, sf):
    g = stories.exact_groups(i.news(spark, sf), "news_id", "text")
    m = e.lead_time(g, "cluster_id", "kind", "published", "tg", "media")
    return m.agg(F.count("*").alias("n"), F.round(F.avg("lead_minutes"), 4).alias("mean_lead"), F.round(t_statistic(F.col("lead_minutes")), 4).alias("t_stat"), F.coalesce(F.sum((F.col("lead_minutes") > 0).cast("long")), F.lit(0)).alias("n_leads"))


@query(f"with {_WINDOW} select cast(off as int) as \"offset\", case when score < 0 then 'neg' when score > 0 then 'pos' else 'neu' end as class, {_STATS.format('ar')} from win where ar is not null group by 1, 2")
def h2_asymmetry(spark, sf):
    w = windows(spark, sf).withColumn("class", F.when(F.col("score") < 0, "neg").when(F.col("score") > 0, "pos").otherwise("neu")).withColumn("offset", F.col("offset").cast("int"))
    return stats(w, "offset", "class")


@query(f"""
with {_WINDOW}, c as (select inst, cast(ntile(3) over (order by cap, inst) as int) as bucket from dim)
select bucket, cast(sign(score) as int) as side, {_STATS.format('ar')} from win join c using (inst) where off = 0 and ar is not null group by 1, 2
""")
def h3_cap_bucket(spark, sf):
    numbered = ranks.number_rows(i.dimension(spark, sf).select("inst", "cap"), ["cap", "inst"], "caps")
    c = numbered.select("inst", ranks.bucket_of(F.col("row_no"), F.col("n_rows"), 3).alias("bucket"))
    w = windows(spark, sf).where("offset = 0").join(c, "inst").withColumn("side", F.signum("score").cast("int"))
    return stats(w, "bucket", "side")


@query(f"""
with ev as (select distinct v.inst, d.sector, v.month, v.score from evts v join dim d on d.inst = v.inst)
select ev.sector, cast(sign(score) as int) as side, {_STATS.format('ar')}
from ev join dim p on p.sector = ev.sector and p.inst <> ev.inst join abn a on a.inst = p.inst and a.month = ev.month where ar is not null group by ev.sector, sign(score)
""")
def h4_spillover(spark, sf):
    """Peers' returns around news of another security of the sector. Per (sector, month) sums minus the own share replace the self-join:
    the peers' mean of x over all but one follows from the sector's count, sum and sum of squares."""
    d = i.dimension(spark, sf).select("inst", "sector")
    ev = i.events_of(spark, sf).join(d, "inst").select("inst", "sector", "month", "score").distinct()
    a = i.abnormal_returns(spark, sf).where("ar is not null").join(d, "inst")
    total = a.groupBy("sector", "month").agg(F.count("*").alias("n_all"), F.sum("ar").alias("s_all"), F.sum(F.col("ar") * F.col("ar")).alias("q_all"))
    j = ev.join(total, ["sector", "month"]).join(a.select("inst", "month", "ar"), ["inst", "month"], "left")
    own = F.coalesce("ar", F.lit(0.0))
    peers = j.select("sector", F.signum("score").cast("int").alias("side"), (F.col("n_all") - F.col("ar").isNotNull().cast("long")).alias("n"), (F.col("s_all") - own).alias("s"), (F.col("q_all") - own * own).alias("q"))
    g = peers.groupBy("sector", "side").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).where("n > 0")
    mean = F.col("s") / F.col("n")
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1))))
    t = F.try_divide(mean, F.nullif(std, F.lit(0.0)) / F.sqrt("n"))
    return g.select("sector", "side", F.round(mean, 6).alias("mean_ar"), F.round(std, 6).alias("std_ar"), "n", F.round(t, 4).alias("t_stat"))
