"""Near copies among the news: by shingles, and by embedding within a span of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vector
from tidemark.operators import latent, minhash, stories
from tidemark.plans import inputs as i
from tidemark.plans.registry import query
from tidemark.work import cut

#: Distinct texts by their words (``cls``), their five-word shingles (``sh``) and the pairs that reach 0.8 (``near``), as SQL sees them.
_NEAR = r"""
ws as (select news_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') as w from stories),
cls as (select news_id, w, case when len(w) = 0 then news_id else min(news_id) over (partition by case when len(w) = 0 then 'alone ' || news_id else array_to_string(w, ' ') end) end as class from ws),
sh as (select distinct news_id, array_to_string(w[k:k + 4], ' ') as s from (select news_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as k from cls where news_id = class and len(w) > 0)),
size as (select news_id, count(*) as n from sh group by 1),
shared as (select * from sh where s in (select s from sh group by s having count(*) > 1)),
near as (select x.news_id as a, y.news_id as b, count(*) / (any_value(p.n) + any_value(q.n) - count(*))::double as jaccard
  from shared x join shared y on x.s = y.s and x.news_id < y.news_id join size p on p.news_id = x.news_id join size q on q.news_id = y.news_id
  group by 1, 2 having count(*) >= 0.8 * (any_value(p.n) + any_value(q.n) - count(*)))
"""


@query(f"with {_NEAR} select a, b, round(jaccard, 6) as jaccard from near")
def minhash_pairs(spark, sf):
    """Links between different texts; copies stand behind their class's representative (``minhash_groups``)."""
    n = i.news(spark, sf).select("news_id", "text")
    own = n.join(minhash.text_classes(n, "news_id", "text").where(F.col("news_id") == F.col("class")).select("news_id"), "news_id", "left_semi")
    return minhash.similar_pairs(own, "news_id", "text", estimates=False).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""
with recursive {_NEAR}, l as (select a, b from near union all select b, a from near), c as (select class as node, class as root from cls union select c.node, l.b from c join l on l.a = c.root),
g as (select node, min(root) as cluster_id from c group by 1), d as (select a, count(*) as n_links from l group by 1)
select cls.news_id, cls.class, g.cluster_id, coalesce(d.n_links, 0) as n_links from cls join g on g.node = cls.class left join d on d.a = cls.class
""")
def minhash_groups(spark, sf):
    return minhash.near_groups(i.news(spark, sf).select("news_id", "text"), "news_id", "text")


def learned(spark, sf):
    n = i.news(spark, sf).select("news_id", "text")
    return cut(latent.learned(n, "news_id", "text"), "embeddings")


@query()
def news_embeddings(spark, sf):
    """Learned vectors of all news. Their directions have a sign of the solver's choosing, so no SQL stands for them; cosines are tested."""
    return learned(spark, sf).select("news_id", "embedding", F.round(vector.norm("embedding"), 4).alias("length"))


@query()
def dedup_learned(spark, sf):
    """Stories that fall together by their learned vectors: ``cosine_links`` over all news."""
    v = learned(spark, sf)
    groups = stories.groups_of(stories.cosine_links(v, "news_id", "embedding", 0.98)).select(F.col("node").alias("news_id"), "cluster_id")
    return v.select("news_id").join(groups, "news_id", "left").select("news_id", F.coalesce("cluster_id", "news_id").alias("cluster_id"))


WINDOW_DAYS = 45


@query(f"""
with e as (select vec_id, embedding, cast(o_orderdate as date) as day from embeddings join orders on o_orderkey = vec_id),
p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as s, cast(abs(date_diff('day', a.day, b.day)) as int) as gap from e a join e b on a.vec_id < b.vec_id and abs(date_diff('day', a.day, b.day)) <= {WINDOW_DAYS})
select a, b, round(s, 4) as similarity, gap from p where s >= 0.2
""")
def window_pairs(spark, sf):
    """Stories alike by embedding within some weeks of each other."""
    o = i.table(spark, sf, "orders").select(F.col("o_orderkey").alias("vec_id"), F.col("o_orderdate").cast("date").alias("day"))
    e = i.table(spark, sf, "embeddings").select("vec_id", "embedding").join(o, "vec_id")
    p = stories.window_pairs(e, "vec_id", "embedding", "day", WINDOW_DAYS, 0.2)
    return p.select("a", "b", F.round("similarity", 4).alias("similarity"), "gap")
