"""News: union, duplicates, sentiment by security, sector and market, days with and without news."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar, vector
from tidemark.operators import macro, sentiment, stories
from tidemark.plans import inputs as i
from tidemark.plans.registry import query


@query("select news_id, kind, source, month from stories where kind = 'tg' union all select news_id, kind, source, month from stories where kind = 'media'")
def news_union(spark, sf):
    n = i.news(spark, sf).select("news_id", "kind", "source", "month")
    return n.where("kind = 'tg'").unionByName(n.where("kind = 'media'"))


_KEY = "md5(trim(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', ' ', 'g')))"
_GROUPS = f"""
k as (select *, case when length(trim(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) > 0 then {_KEY} else 'alone ' || news_id end as h from stories),
g as (select *, min(news_id) over (partition by h) as cluster_id from k)
"""


@query(f"with {_GROUPS} select news_id, cluster_id, news_id = cluster_id as kept from g")
def dedup_exact(spark, sf):
    g = stories.exact_clusters(i.news(spark, sf), "news_id", "text")
    return g.select("news_id", "cluster_id", (F.col("news_id") == F.col("cluster_id")).alias("kept"))


@query(f"with {_GROUPS}, r as (select *, row_number() over (partition by cluster_id order by published, news_id) as k from g) select cluster_id, news_id, source, published from r where k = 1")
def story_representatives(spark, sf):
    g = stories.exact_groups(i.news(spark, sf), "news_id", "text")
    return stories.representatives(g, "cluster_id", "published", "news_id").select("cluster_id", "news_id", "source", "published")


_PAIRS = "p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as s from embeddings a join embeddings b on a.vec_id < b.vec_id)"


@query(f"with {_PAIRS} select a, b, round(s, 4) as similarity from p where s >= 0.4")
def cosine_pairs(spark, sf):
    p = stories.cosine_pairs(i.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4)
    return p.select("a", "b", F.round("similarity", 4).alias("similarity"))


@query(f"""
with recursive {_PAIRS}, l as (select a, b from p where s >= 0.4 union all select b, a from p where s >= 0.4),
c as (select a as node, a as root from l union select c.node, l.b from c join l on l.a = c.root)
select node as news_id, min(root) as cluster_id from c group by node
""")
def dedup_cosine(spark, sf):
    p = stories.cosine_links(i.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4)
    return stories.groups_of(p).select(F.col("node").alias("news_id"), "cluster_id")


@query()
def lsh_pairs(spark, sf):
    """Approximate: its pairs are true ones, its recall is tested, so no SQL stands for it."""
    return stories.lsh_pairs(i.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4).select("a", "b", F.round("similarity", 4).alias("similarity"))


_AGG = "count(score) as n_news, round(avg(score), 6) as sent, cast(sum(case when score < 0 then 1 else 0 end) as bigint) as n_neg, cast(sum(case when score > 0 then 1 else 0 end) as bigint) as n_pos"


def _sent(df, *keys):
    return sentiment.aggregate(df, list(keys), "score").withColumn("sent", F.round("sent", 6))


@query(f"select inst, month, {_AGG} from evts group by 1, 2")
def sent_instrument(spark, sf):
    return _sent(i.events_of(spark, sf), "inst", "month")


@query(f"select sector, month, {_AGG} from evts join dim using (inst) group by 1, 2")
def sent_sector(spark, sf):
    return _sent(i.events_of(spark, sf).join(i.dimension(spark, sf), "inst"), "sector", "month")


@query(f"select month, {_AGG} from stories join scored using (news_id) group by 1")
def sent_market(spark, sf):
    return _sent(i.news(spark, sf).join(i.scores(spark, sf), "news_id"), "month")


@query(f"select kind, lang, {_AGG} from stories join scored using (news_id) group by 1, 2")
def sent_by_kind(spark, sf):
    return _sent(i.news(spark, sf).join(i.scores(spark, sf), "news_id"), "kind", "lang")


#: Sentiment of macro and geopolitical news by scope, as SQL sees it: ``ms`` by month, ``ss`` by month and sector.
SCOPES = "ms as (select month, avg(score) as sent from sigs where scope = 'market' group by 1), ss as (select sector, month, avg(score) as sent from sigs where scope = 'sector' group by 1, 2)"


@query(f"select 'market' as scope, cast(null as varchar) as sector, month, {_AGG} from sigs where scope = 'market' group by month union all select 'sector', sector, month, {_AGG} from sigs where scope = 'sector' group by sector, month")
def macro_sentiment(spark, sf):
    """Scored macro and geopolitical news, branched by the scope of its signal."""
    market, sector = macro.by_scope(i.signalled(spark, sf), "month", "score")
    named = lambda df, scope: df.select(F.lit(scope).alias("scope"), (F.col("sector") if scope == "sector" else F.lit(None).cast("string")).alias("sector"), "month", "n_news", F.round("sent", 6).alias("sent"), "n_neg", "n_pos")
    return named(market, "market").unionByName(named(sector, "sector"))


@query(f"select inst, month, {_AGG} from sigs join dim using (inst) group by 1, 2")
def macro_by_security(spark, sf):
    """Sentiment of macro and geopolitical news by the securities that its signals name; names outside the dimension are gone."""
    named = macro.only_macro(i.signalled(spark, sf)).select("month", "score", F.explode(F.col("signal.tickers").cast("array<bigint>")).alias("inst"))
    return _sent(named, "inst", "month")


@query(f"""
with {SCOPES} select b.inst, b.month, round(coalesce(ms.sent, 0), 6) as market_sent, round(coalesce(ss.sent, 0), 6) as sector_sent
from bars b join dim d on d.inst = b.inst left join ms on ms.month = b.month left join ss on ss.month = b.month and ss.sector = d.sector
""")
def scope_features(spark, sf):
    market, sector = macro.by_scope(i.signalled(spark, sf), "month", "score")
    panel = i.bars(spark, sf).join(i.dimension(spark, sf).select("inst", "sector"), "inst").select("inst", "month", "sector")
    out = sentiment.spread_scopes(panel, market, sector, "month", "sector")
    return out.select("inst", "month", F.round("market_sent", 6).alias("market_sent"), F.round("sector_sent", 6).alias("sector_sent"))


@query("""
with n as (select distinct inst, month from evts)
select 'with' as side, count(*) as n, round(avg(fwd), 6) as mean_fwd from rets r where exists (select 1 from n where n.inst = r.inst and n.month = r.month)
union all select 'without', count(*), round(avg(fwd), 6) from rets r where not exists (select 1 from n where n.inst = r.inst and n.month = r.month)
""")
def semi_anti_news_days(spark, sf):
    n, r = i.events_of(spark, sf).select("inst", "month"), i.returns(spark, sf)
    side = lambda how, name: r.join(n, ["inst", "month"], how).agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.round(F.avg("fwd"), 6).alias("mean_fwd"))
    return side("left_semi", "with").unionByName(side("left_anti", "without"))


@query("select lang, source, month from stories where kind = 'tg' and month in (select month from stories where kind = 'media') except select lang, source, month from stories where length(text) < 500")
def coverage_except(spark, sf):
    """Cells of the Telegram coverage without any short text, in months that the media cover too."""
    n = i.news(spark, sf)
    cells = n.where("kind = 'tg'").join(n.where("kind = 'media'").select("month"), "month", "left_semi").select("lang", "source", "month")
    return cells.subtract(n.where(F.length("text") < 500).select("lang", "source", "month"))


@query(f"with {_GROUPS} select cluster_id from g where kind = 'tg' intersect select cluster_id from g where kind = 'media'")
def stories_in_both_kinds(spark, sf):
    g = stories.exact_groups(i.news(spark, sf), "news_id", "text")
    return g.where("kind = 'tg'").select("cluster_id").intersect(g.where("kind = 'media'").select("cluster_id"))


@query("select kind, count(*) as n_news, count(distinct source) as n_sources, count(distinct lang) as n_langs, count(distinct month) as n_months from stories group by kind")
def news_coverage(spark, sf):
    return i.news(spark, sf).groupBy("kind").agg(F.count("*").alias("n_news"), F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"), F.count_distinct("month").alias("n_months"))


@query(r"""
with w as (select news_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t in ('рост', 'прибыль', 'рекорд', 'gain', 'growth', 'profit')) as good,
  list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t in ('падение', 'убыток', 'санкции', 'loss', 'trash', 'disgusting', 'fraud')) as bad from stories),
c as (select news_id, len(good) as g, len(bad) as b from w)
select news_id, case when g <= 1 and b <= 1 then 'neu' when b >= g then 'neg' else 'pos' end as label, round((g - b) / (1.0e0 + g + b), 6) as net from c
""")
def stub_sentiment(spark, sf):
    """The model boundary with its stand-in scorer."""
    s = sentiment.score(i.news(spark, sf).select("news_id", "text"), "text")
    return s.select("news_id", sentiment.label(F.col("sentiment.neg"), F.col("sentiment.neu"), F.col("sentiment.pos")).alias("label"), F.round(sentiment.net("sentiment"), 6).alias("net"))


@query("select news_id, 64 as size, length(regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g')) > 0 as has_words from stories")
def stub_embeddings(spark, sf):
    """The embedding boundary with its stand-in model: vectors of unit length, of zeros for texts without words."""
    e = vector.embed(i.news(spark, sf).select("news_id", "text"), "text")
    has_words = F.when(F.col("text").isNotNull(), F.round(vector.norm("embedding"), 4) == 1)
    return e.select("news_id", F.size("embedding").alias("size"), has_words.alias("has_words"))


@query("""
with t as (select month, source, count(*) as n from stories where kind = 'tg' group by 1, 2), m as (select month, source, count(*) as n from stories where kind = 'media' group by 1, 2),
a as (select month, sum(n) as n_tg from t group by 1), b as (select month, sum(n) as n_media from m where source <> 'src10' group by 1)
select coalesce(a.month, b.month) as month, cast(n_tg as bigint) as n_tg, cast(n_media as bigint) as n_media from a full outer join b on a.month = b.month
""")
def coverage_both_sides(spark, sf):
    """Months of either kind side by side; a month that one kind lacks stays, with null."""
    n = i.news(spark, sf)
    side = lambda rows, name: rows.groupBy("month").agg(F.count("*").alias(name))
    return side(n.where("kind = 'tg'"), "n_tg").join(side(n.where("kind = 'media' and source <> 'src10'"), "n_media"), "month", "full_outer").select("month", "n_tg", "n_media")


@query("select lang, month from stories where kind = 'tg' except all select lang, month from stories where kind = 'media'")
def coverage_surplus(spark, sf):
    """One row for each Telegram story of a language and month beyond the media's number."""
    n = i.news(spark, sf).select("kind", "lang", "month")
    return n.where("kind = 'tg'").select("lang", "month").exceptAll(n.where("kind = 'media'").select("lang", "month"))


@query("select kind, count(distinct news_id) as n, count(distinct source) as n_sources, count(distinct source) as about_sources from stories group by kind")
def news_coverage_approx(spark, sf):
    """Approximate distinct counts beside exact ones. A kind has few sources, which the sketch counts exactly, and many stories, which it is held to within a tenth."""
    n = i.news(spark, sf)
    got = n.groupBy("kind").agg(F.count_distinct("news_id").alias("n"), F.count_distinct("source").alias("n_sources"), F.approx_count_distinct("source", 0.02).alias("about_sources"), F.approx_count_distinct("news_id", 0.02).alias("about"))
    near = F.abs(F.col("about") - F.col("n")) <= F.col("n") / 10
    return got.select("kind", F.when(near, F.col("n")).otherwise(F.col("about")).alias("n"), "n_sources", "about_sources")


@query("""
with t as (select news_id, published, timezone('Europe/Moscow', timezone('UTC', published + to_hours(cast(news_id % 24 as int)))) as local from stories)
select news_id, local, cast(case when hour(local) >= 18 then local + interval 1 day else local end as date) as trading_day from t
""")
def exchange_days(spark, sf):
    """Publication on the exchange's clock, and the day that can trade on it: the next one after the close. Times of day are stand-ins out of ids."""
    at = (F.col("published") + F.make_dt_interval(hours=(F.col("news_id") % 24).cast("int"))).alias("at")
    n = i.news(spark, sf).select("news_id", at)
    return n.select("news_id", calendar.to_zone("at").alias("local"), calendar.trading_day("at", close_hour=18).alias("trading_day"))
