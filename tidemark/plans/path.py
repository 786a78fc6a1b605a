"""From news to sentiment by security, end to end on the given texts: near copies fall together, mentions are searched once a story, and the trained scorer reads what names a security."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import macro, mentions as m, minhash, scorer, sentiment, stories
from tidemark.plans import inputs as i
from tidemark.plans.copies import _NEAR
from tidemark.plans.registry import query
from tidemark.plans.text import _FORMS, _TICKERS, SECURITIES
from tidemark.work import cut

#: Stories once: the earliest of each group of near copies (``once``), and the tickers that it names (``named``), as SQL sees them.
_ONCE = f"""
{_NEAR}, l as (select a, b from near union all select b, a from near), c as (select class as node, class as root from cls union select c.node, l.b from c join l on l.a = c.root),
g as (select node, min(root) as cluster_id from c group by 1),
once as (select * from (select s.*, cls.w, g.cluster_id, row_number() over (partition by g.cluster_id order by s.published, s.news_id) as k from stories s join cls on cls.news_id = s.news_id join g on g.node = cls.class) where k = 1),
grams as (select news_id, kind, month, unnest(w) as form from once union all select news_id, kind, month, w[k] || ' ' || w[k + 1] from (select news_id, kind, month, w, unnest(range(1, len(w))) as k from once)),
f(form, ticker, tg) as (select *, false from (values {_FORMS}) union all select *, true from (values {_TICKERS})),
named as (select distinct news_id, kind, month, ticker from grams join f using (form) where kind = 'tg' or not tg)
"""


def stories_once(spark, sf):
    """News without near copies: of each group the earliest story."""
    n = i.news(spark, sf)
    groups = minhash.near_groups(n.select("news_id", "text"), "news_id", "text").select("news_id", "cluster_id")
    return cut(stories.representatives(n.join(groups, "news_id"), "cluster_id", "published", "news_id"), "stories-once")


def named(spark, sf, once):
    """``news_id, ticker`` by the variant of each kind of news."""
    return reduce(lambda a, b: a.unionByName(b), (m.search(spark, once, SECURITIES, v, kind="kind") for v in (m.TELEGRAM, m.MEDIA)))


def labels(spark, sf):
    """``news_id, label`` of labelled news: toxic is negative, else good is positive."""
    label = F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos").otherwise("neu")
    return i.table(spark, sf, "labels").select(F.col("doc_id").alias("news_id"), label.alias("label"))


def trained(spark, sf):
    return scorer.fit(i.news(spark, sf).select("news_id", "text"), labels(spark, sf))


@query(f"with recursive {_ONCE} select ticker, kind, month, count(*) as n_news from named group by 1, 2, 3")
def path_mentions(spark, sf):
    """Stories by security, kind and month, copies counted once."""
    once = stories_once(spark, sf)
    return named(spark, sf, once).join(once.select("news_id", "kind", "month"), "news_id").groupBy("ticker", "kind", "month").agg(F.count("*").alias("n_news"))


@query()
def path_sentiment(spark, sf):
    """Trained sentiment by security and month. The fit is beyond SQL: held-out accuracy is tested, and the counts against ``path_mentions``."""
    once = stories_once(spark, sf)
    hits = cut(named(spark, sf, once), "named")
    read = scorer.score(once.join(hits.select("news_id").distinct(), "news_id", "left_semi").select("news_id", "month", "text"), "text", trained(spark, sf))
    scored = read.select("news_id", "month", sentiment.net("sentiment").alias("score"))
    out = sentiment.aggregate(hits.join(scored, "news_id"), ["ticker", "month"], "score")
    return out.withColumn("sent", F.round("sent", 6))


@query()
def news_scores(spark, sf):
    """The trained scorer over all news, beside the label where there is one."""
    s = scorer.score(i.news(spark, sf).select("news_id", "text"), "text", trained(spark, sf))
    net = F.round(sentiment.net("sentiment"), 6).alias("net")
    s = s.select("news_id", scorer.held_out("news_id").alias("held_out"), sentiment.label(F.col("sentiment.neg"), F.col("sentiment.neu"), F.col("sentiment.pos")).alias("predicted"), net)
    return s.join(labels(spark, sf), "news_id", "left")


#: Sectors that the synthetic texts can speak of: a stand-in name each.
SECTOR_WORDS = {ticker: m.words(name)[:1] for ticker, name in SECURITIES[:4]}


@query()
def macro_path(spark, sf):
    """Macro and geopolitical news out of the texts themselves: classified, scored by the trained scorer, by scope, sector and month."""
    answered = macro.classify(stories_once(spark, sf).select("news_id", "month", "text"), "text", lambda: macro.load_rules(SECTOR_WORDS))
    known = i.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"))
    kept = cut(macro.only_macro(macro.signals(answered, "answer", known)), "macro-news")
    scored = scorer.score(kept, "text", trained(spark, sf)).withColumn("score", sentiment.net("sentiment"))
    market, sector = macro.by_scope(scored, "month", "score")
    both = market.select(F.lit("market").alias("scope"), F.lit(None).cast("string").alias("sector"), *market.columns).unionByName(sector.select(F.lit("sector").alias("scope"), *sector.columns))
    return both.withColumn("sent", F.round("sent", 6))
