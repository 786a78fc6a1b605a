"""The engine's inputs out of the driver's tables, in both engines.

Stand-ins: instrument = supplier, sector = nation, market = region; trades = line items; news = documents, published on the date of the
order of the same id; mentions = suppliers of that order's items; sentiment = labels (toxic -1, good +1, else 0).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.bars import with_returns


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").where("l_quantity > 0")
    return t.select(F.col("l_suppkey").alias("inst"), F.col("l_shipdate").cast("date").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly volume-weighted prices."""
    t = trades(spark, sf).groupBy("inst", F.date_trunc("month", "d").cast("date").alias("month"))
    return t.agg((F.sum(F.col("px") * F.col("qty")) / F.sum("qty")).alias("px"), F.sum("qty").alias("volume"))


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return with_returns(bars(spark, sf), "inst", "month", "px")


def index(spark: SparkSession, sf: str) -> DataFrame:
    """The market's monthly price and return: ``month, ipx, iret``."""
    from pyspark.sql import Window

    i = bars(spark, sf).groupBy("month").agg((F.sum(F.col("px") * F.col("volume")) / F.sum("volume")).alias("ipx"))
    # One row per month by now: the unpartitioned window is as small as the calendar.
    return i.withColumn("iret", F.col("ipx") / F.lag("ipx").over(Window.orderBy("month")) - 1)


def abnormal_returns(spark: SparkSession, sf: str) -> DataFrame:
    """``inst, month, ar``: returns over the market's."""
    return returns(spark, sf).join(index(spark, sf), "month").select("inst", "month", (F.col("ret") - F.col("iret")).alias("ar"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    """``news_id, text, lang, source, kind, published, month``."""
    d, o = table(spark, sf, "documents"), table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    kind = F.when(F.regexp_extract("source", "[0-9]+$", 0).try_cast("int") < 10, "tg").otherwise("media")
    n = d.join(o, d.doc_id == o.o_orderkey)
    return n.select(F.col("doc_id").alias("news_id"), "text", "lang", "source", kind.alias("kind"), F.col("o_orderdate").alias("published"), F.date_trunc("month", "o_orderdate").cast("date").alias("month"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ``news_id, inst``."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("news_id"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("news_id"), F.col("l_suppkey").alias("inst")).distinct().join(d, "news_id", "left_semi")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """``news_id, score`` of labelled news."""
    score = F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    return table(spark, sf, "labels").select(F.col("doc_id").alias("news_id"), score.alias("score"))


def dimension(spark: SparkSession, sf: str) -> DataFrame:
    """``inst, name, sector, market, cap``. Tens of sectors; the instruments' side is left to the optimizer."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("s_suppkey").alias("inst"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"), F.col("r_name").alias("market"), F.col("s_acctbal").alias("cap"))


def events_of(spark: SparkSession, sf: str) -> DataFrame:
    """Scored mentions: ``news_id, inst, month, kind, score``."""
    n = news(spark, sf).select("news_id", "month", "kind")
    return mentions(spark, sf).join(n, "news_id").join(scores(spark, sf), "news_id")


def signalled(spark: SparkSession, sf: str) -> DataFrame:
    """Scored news with the signal parsed from a model's answer: ``news_id, month, score, signal``.

    The answers are stand-ins made from ids: two of three news are macro or geopolitical, half of them about a sector.
    """
    from tidemark.operators import macro

    s = news(spark, sf).select("news_id", "month").join(scores(spark, sf), "news_id")
    sectors = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("_nation"), F.col("n_name").alias("_sector"))
    s = s.withColumn("_nation", F.col("news_id") % 25).join(sectors, "_nation", "left")
    kind = F.when(F.col("news_id") % 3 == 0, "macro").when(F.col("news_id") % 3 == 1, "geo").otherwise("other")
    wide = F.col("news_id") % 2 == 0
    answer = F.struct(kind.alias("class"), F.when(wide, "market").otherwise("sector").alias("scope"), F.when(~wide, F.col("_sector")).alias("sector"), F.array((F.col("news_id") % 40 + 1).cast("string"), F.lit("none such")).alias("tickers"))
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"))
    return macro.signals(s.select("news_id", "month", "score", F.to_json(answer).alias("answer")), "answer", known).drop("answer")


#: The same in SQL; ``with_inputs`` puts those before a query that it names, directly or through each other.
CTES = {
    "trades": "select l_suppkey as inst, cast(l_shipdate as date) as d, l_extendedprice / l_quantity as px, l_quantity as qty from lineitem where l_quantity > 0",
    "bars": "select inst, cast(date_trunc('month', d) as date) as month, sum(px * qty) / sum(qty) as px, sum(qty) as volume from trades group by 1, 2",
    "rets": "select *, px / lag(px) over w - 1 as ret, ln(px / lag(px) over w) as log_ret, lead(px) over w / px - 1 as fwd, lead(px, 2) over w / lead(px) over w - 1 as hold from bars window w as (partition by inst order by month)",
    "idx": "select *, ipx / lag(ipx) over (order by month) - 1 as iret from (select month, sum(px * volume) / sum(volume) as ipx from bars group by month)",
    "abn": "select r.inst, r.month, r.ret - i.iret as ar from rets r join idx i on i.month = r.month",
    "stories": "select d.doc_id as news_id, d.text, d.lang, d.source, case when try_cast(regexp_extract(d.source, '[0-9]+$') as int) < 10 then 'tg' else 'media' end as kind, o.o_orderdate as published, cast(date_trunc('month', o.o_orderdate) as date) as month from documents d join orders o on o.o_orderkey = d.doc_id",
    "mentioned": "select distinct l_orderkey as news_id, l_suppkey as inst from lineitem where l_orderkey in (select doc_id from documents)",
    "scored": "select doc_id as news_id, case when toxic = 1 then -1.0e0 when quality = 1 then 1.0e0 else 0.0e0 end as score from labels",
    "dim": "select s_suppkey as inst, s_name as name, n_name as sector, r_name as market, s_acctbal as cap from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey",
    "sigs": "select s.news_id, s.month, c.score, case when s.news_id % 2 = 0 then 'market' else 'sector' end as scope, case when s.news_id % 2 = 1 then n_name end as sector, s.news_id % 40 + 1 as inst, case s.news_id % 3 when 0 then 'macro' else 'geo' end as class from stories s join scored c on c.news_id = s.news_id join nation on n_nationkey = s.news_id % 25 where s.news_id % 3 < 2",
    "evts": "select m.news_id, m.inst, s.month, s.kind, c.score from mentioned m join stories s on s.news_id = m.news_id join scored c on c.news_id = m.news_id",
}


def with_inputs(sql: str) -> str:
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if re.search(rf"\b{name}\b(?!\()", text) and name not in need:
                visit(body)
                if name not in need:
                    need.append(name)

    visit(sql)
    head = ", ".join(f"{n} as ({CTES[n]})" for n in need)
    sql = sql.strip()
    if not need:
        return sql
    if re.match(r"with\b", sql):
        rest = sql[4:].lstrip()
        recursive = rest.startswith("recursive")
        return f"with {'recursive ' if recursive else ''}{head}, {rest[9:].lstrip() if recursive else rest}"
    return f"with {head} {sql}"
