"""Texts, HTML, JSON, mentions by name, macro signals, and the click-stream's windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import text_key, tokens
from tidemark.operators import macro, mentions as m
from tidemark.plans import inputs as i
from tidemark.plans.registry import query
from tidemark.sources import html as h
from tidemark.streaming import windows

# Stand-in names for the synthetic texts: (ticker, name); the last has two words.
SECURITIES = [("ERHE", "Erhe"), ("THES", "Thes (Ofth)"), ("TION", "Tion — ordinary"), ("INGS", "Ingsh+"), ("OFTH", "of the")]


@query(r"select news_id, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) as n_tokens, md5(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'))) as text_key, text is not null and length(trim(text)) > 0 as has_text from stories")
def text_normalise(spark, sf):
    n = i.news(spark, sf)
    return n.select("news_id", F.size(tokens("text")).cast("long").alias("n_tokens"), text_key("text").alias("text_key"), (F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).alias("has_text"))


# Written apart from ``mentions.dictionary``: no rule inflects a Latin word, Telegram also reads tickers.
_FORMS = "('erhe', 'ERHE'), ('thes', 'THES'), ('ofth', 'THES'), ('tion', 'TION'), ('ingsh', 'INGS'), ('of the', 'OFTH')"
_TICKERS = "('erhe', 'ERHE'), ('thes', 'THES'), ('tion', 'TION'), ('ings', 'INGS'), ('ofth', 'OFTH')"


def _mention_sql(variant: m.Variant) -> str:
    words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
    return f"""
with w as (select news_id, {words} as ws from stories where kind = '{variant.kind}'),
g as (select news_id, unnest(ws) as form from w union all select news_id, ws[k] || ' ' || ws[k + 1] from (select news_id, ws, unnest(range(1, len(ws))) as k from w)),
f(form, ticker) as (values {f'{_FORMS}, {_TICKERS}' if variant.tickers else _FORMS})
select distinct news_id, ticker from g join f using (form)
"""


def _mention(spark, sf, variant):
    return m.search(spark, i.news(spark, sf), SECURITIES, variant, kind="kind")


@query(_mention_sql(m.TELEGRAM))
def mentions_telegram(spark, sf):
    return _mention(spark, sf, m.TELEGRAM)


@query(_mention_sql(m.MEDIA))
def mentions_media(spark, sf):
    return _mention(spark, sf, m.MEDIA)


@query("""
with t as (select news_id, unnest([chr(cast(65 + news_id % 26 as int)) || 'A', chr(cast(65 + news_id % 7 as int))]) as ticker, unnest([8, 12]) as place from stories where news_id % 5 > 0)
select news_id, ticker, place from t
""")
def cash_tags(spark, sf):
    """Tags by a table function; the texts are stand-ins made from ids, a fifth of them without any tag."""
    letter = lambda n: F.chr(65 + F.col("news_id") % n)
    tagged = F.concat(F.lit("news of $"), letter(26), F.lit("A $"), letter(7), F.lit(", not $lower, $TOOLONG or US$"))
    n = i.news(spark, sf).select("news_id", F.when(F.col("news_id") % 5 > 0, tagged).otherwise("none").alias("text"))
    return m.cash_tags(n, "news_id", "text")


@query(r"""
with t as (select lang, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) as token from stories),
c as (select lang, token, count(*) as n from t group by 1, 2), r as (select *, cast(row_number() over (partition by lang order by n desc, token) as int) as rank from c)
select lang, token, n, rank from r where rank <= 20
""")
def mention_tokens(spark, sf):
    """The commonest tokens of each language: a top-k report."""
    from pyspark.sql import Window

    t = i.news(spark, sf).select("lang", F.explode(tokens("text")).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).where("rank <= 20").select("lang", "token", "n", "rank")


# Written apart from ``sources.html``: the pages hold no other hidden elements and no other references than these.
@query(r"""
with x as (select page_id, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) as host, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<head>.*?</head>', ' ', 'g'), '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '<[^>]*>', ' ', 'g') as article from pages),
d as (select page_id, host, unnest(['title', 'article']) as part, trim(regexp_replace(replace(replace(replace(replace(unnest([title, article]), '&quot;', '"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&'), '\s+', ' ', 'g')) as t from x)
select page_id, host, max(t) filter (part = 'title') as title, cast(max(length(t)) filter (part = 'article') as int) as n_chars, md5(max(t) filter (part = 'article')) as article_md5 from d group by page_id, host
""")
def html_extract(spark, sf):
    x = i.table(spark, sf, "pages").select("page_id", h.host(F.coalesce("url", F.lit(""))).alias("host"), h.title("html").alias("title"), h.article("html").alias("article"))
    return x.select("page_id", "host", "title", F.length("article").alias("n_chars"), F.md5("article").alias("article_md5"))


# Written apart from ``html.blocks`` and ``html.run``: prefix sums over rows in place of a fold, and only the references and tags that the pages hold.
@query(rf"""
with x as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<head>.*?</head>', ' ', 'g') as h from pages),
m as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<(nav|footer)>', chr(1) || 'OPEN', 'g'), '</(nav|footer)>', 'SHUT' || chr(1), 'g'), '<h1>', chr(1) || 'HEAD', 'g'),
  '</?(?:html|body|ul|li|div|article|p|h1)(?:\s[^>]*)?>', chr(1), 'g'), '<a(?:\s[^>]*)?>', chr(2), 'g'), '</a>', chr(3), 'g') as h from x),
d as (select page_id, replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&') as h from m),
b as (select page_id, unnest(range(0, len(parts))) as k, unnest(parts) as part from (select page_id, string_split(h, chr(1)) as parts from d)),
c as (select page_id, k, starts_with(part, 'HEAD') as heading, cast(starts_with(part, 'OPEN') as int) as opens, cast(ends_with(part, 'SHUT') as int) as shuts, replace(replace(replace(part, 'HEAD', ''), 'OPEN', ''), 'SHUT', '') as t from b),
f as (select *, trim(regexp_replace(translate(t, chr(2) || chr(3), ''), '\s+', ' ', 'g')) as text, trim(regexp_replace(regexp_replace(t, chr(2) || '[^' || chr(2) || chr(3) || ']*' || chr(3), ' ', 'g'), '\s+', ' ', 'g')) as outside from c),
n as (select *, case when text = '' then 0 else len(string_split(text, ' ')) end as n_words, case when outside = '' then 0 else len(string_split(outside, ' ')) end as n_free,
  sum(opens) over w - coalesce(sum(shuts) over (partition by page_id order by k rows between unbounded preceding and 1 preceding), 0) as depth from f window w as (partition by page_id order by k)),
g as (select *, case when text = '' then 0 when depth > 0 then -n_words - {h.BLOCK_COST} else n_words - {h.LINK_COST} * (n_words - n_free) - case when heading then 0 else {h.BLOCK_COST} end end as gain from n),
s as (select *, sum(gain) over (partition by page_id order by k) as upto from g),
l as (select *, least(0, min(upto) over (partition by page_id order by k rows between unbounded preceding and 1 preceding)) as low from s),
e as (select page_id, min_by(k, (-(upto - low), k)) as last, min_by(low, (-(upto - low), k)) as low, max(upto - low) as best from l group by 1),
r as (select e.page_id, e.last, coalesce(max(s.k) + 1, 0) as first from e left join s on s.page_id = e.page_id and s.k < e.last and s.upto = e.low where e.best > 0 group by 1, 2)
select p.page_id, count(n.k) as n_blocks, cast(coalesce(sum(n.n_words), 0) as bigint) as n_words, cast(coalesce(sum(n.n_words - n.n_free), 0) as bigint) as n_linked, md5(coalesce(string_agg(n.text, chr(10) order by n.k), '')) as body_md5
from pages p left join r on r.page_id = p.page_id left join n on n.page_id = p.page_id and n.k between r.first and r.last and n.text <> '' group by 1
""")
def article_extract(spark, sf):
    """The article of each page by the density of text and links in its blocks."""
    x = h.extract(i.table(spark, sf, "pages").select("page_id", "html"), "html")
    total = lambda c: F.aggregate(F.col("blocks")[c], F.lit(0).cast("long"), lambda a, v: a + v)
    return x.select("page_id", F.size("blocks").cast("long").alias("n_blocks"), total("n_words").alias("n_words"), total("n_linked").alias("n_linked"), F.md5("body").alias("body_md5"))


@query("select event_type, cast(json_extract(props, '$.k') as int) as k, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def json_props(spark, sf):
    e = i.table(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
with a as (select doc_id as news_id, case when toxic = 1 then 'geo' else 'macro' end as class, case when quality = 1 then 'market' else 'sector' end as scope, doc_id % 10 as k from labels),
u as (select news_id, class, scope, unnest([k, k + 1]) as t from a)
select news_id, class, scope, 'T' || t as ticker from u where t < 10
""")
def macro_signals(spark, sf):
    """Signals parsed from model answers (stand-ins made from the labels), one row per ticker; the dimension knows T0 to T9, so T10 falls out of the lists."""
    la = i.table(spark, sf, "labels")
    k = F.col("doc_id") % 10
    answer = F.to_json(F.struct(F.when(F.col("toxic") == 1, "geo").otherwise("macro").alias("class"), F.when(F.col("quality") == 1, "market").otherwise("sector").alias("scope"), F.lit("any").alias("sector"), F.array(F.concat(F.lit("T"), k), F.concat(F.lit("T"), k + 1)).alias("tickers")))
    dim = spark.range(10).select(F.concat(F.lit("T"), "id").alias("ticker"))
    s = macro.only_macro(macro.signals(la.select(F.col("doc_id").alias("news_id"), answer.alias("answer")), "answer", dim))
    return s.select("news_id", "signal.class", "signal.scope", F.explode("signal.tickers").alias("ticker"))


@query("select news_id, case when regexp_matches(lower(text), 'санкц|войн|sanction|conflict') then 'geo' when regexp_matches(lower(text), 'ставк|инфляц|ввп|rate|inflation|gdp') then 'macro' else 'other' end as class from stories")
def macro_classify(spark, sf):
    """The classifier boundary with its stand-in rules."""
    n = i.news(spark, sf).select("news_id", "text")
    return macro.classify(n, "text").select("news_id", F.get_json_object("answer", "$.class").alias("class"))


@query("select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark, sf):
    e = i.table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("event_type", F.col("window.start").alias("start"), "n", "total")


@query("""
select time_bucket(interval 30 minute, ts) - to_minutes(30 * o) as start, event_type, count(*) as n from events, (values (0), (1)) v(o) group by 1, 2
""")
def events_sliding(spark, sf):
    e = i.table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n")


@query("""
with g as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts) as k from g)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k
""")
def events_sessions(spark, sf):
    e = i.table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


@query("""
select cast(s as timestamp) as start, cast(s + interval 1 hour as timestamp) as "end", event_type, count(*) as n, round(sum(value), 4) as total
from (select *, time_bucket(interval 1 hour, ts) as s from events) where s + interval 1 hour <= (select max(ts) from events) - interval 10 minute group by 1, 2, 3
""")
def stream_tumbling(spark, sf):
    """The hourly aggregate as a stream: windows appear once the watermark has passed them, so the last one stays open."""
    out = windows.drain(windows.tumbling(windows.open_events(spark, f"{sf}/events.parquet"), "1 hour", ["event_type"]), "hourly")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
with g as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts) as k from g),
c as (select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k)
select * from c where "end" <= (select max(ts) from events) - interval 10 minute
""")
def stream_sessions(spark, sf):
    """Sessions as a stream: those that the watermark has not passed may still grow, and wait."""
    out = windows.drain(windows.sessions(windows.open_events(spark, f"{sf}/events.parquet"), "30 minutes", "user_id"), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select event_id, user_id, event_type, value from events")
def stream_once(spark, sf):
    """Events that a collector delivers twice come out once."""
    path = f"{sf}/events.parquet"
    twice = windows.open_events(spark, path).unionByName(windows.open_events(spark, path))
    return windows.drain(windows.first_seen(twice, ["event_id"]), "once").select("event_id", "user_id", "event_type", "value")


@query("select inst, name, n_news, cast(rank as int) as rank from (select inst, name, count(*) as n_news, row_number() over (order by count(*) desc, inst) as rank from mentioned join dim using (inst) group by 1, 2) where rank <= 10")
def most_mentioned(spark, sf):
    """A report: global order and limit, which Spark takes per partition first."""
    from pyspark.sql import Window

    top = i.mentions(spark, sf).join(i.dimension(spark, sf), "inst").groupBy("inst", "name").agg(F.count("*").alias("n_news")).orderBy(F.desc("n_news"), "inst").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_news"), "inst")))
