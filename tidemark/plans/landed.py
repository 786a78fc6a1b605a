"""Sources and sinks: tables of the tests landed as collectors would leave them, read back by the engine's readers."""

from __future__ import annotations

import json

from pyarrow.fs import FileSelector, LocalFileSystem
from pyspark.sql import functions as F

from tidemark.operators import bars as b
from tidemark.plans import inputs as i
from tidemark.plans.registry import query
from tidemark.sources import landed, sqlite_parts as parts, tickers
from tidemark.streaming import windows
from tidemark.work import fresh, open_fs


def land(df, kind: str, fmt: str):
    """Writes ``df`` as files of ``fmt`` and reads them as one of ``landed.MARKET``."""
    spark, path = df.sparkSession, fresh(df.sparkSession, f"landed-{kind}")
    df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in landed.MARKET[kind]))
    if fmt == "csv":
        df.write.option("header", True).csv(path)
    else:
        landed.write_table(df, path, fmt)
    return landed.read_market(spark, kind, path, fmt)


@query("""
with c as (select inst, d, max(px) as close, sum(qty) as volume from trades group by 1, 2)
select cast(inst as varchar) as ticker, cast(date_trunc('month', d) as date) as period, round(min_by(close, d) + 1e-7, 4) as open, round(max_by(close, d) + 1e-7, 4) as close, sum(volume) as volume from c group by 1, 2
""")
def landed_candles(spark, sf):
    """Candles of each day, landed as Parquet, resampled by month."""
    t = i.trades(spark, sf).groupBy(F.col("inst").cast("string").alias("ticker"), F.col("d").alias("ts"))
    c = t.agg(F.max("px").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max("px").alias("close"), F.sum("qty").alias("volume"))
    out = b.resample(land(c, "candles", "parquet"), "ticker", "ts", "close", "volume")
    return out.select("ticker", "period", F.round(F.col("open") + 1e-7, 4).alias("open"), F.round(F.col("close") + 1e-7, 4).alias("close"), "volume")


@query("""
with o as (select cast(date_trunc('month', o_orderdate) as date) as since, avg(o_totalprice) as price, max(o_totalprice) as top from orders group by 1),
dv as (select l_suppkey as inst, cast(date_trunc('month', l_shipdate) as date) as since, sum(l_tax) as amount from lineitem where l_returnflag = 'R' group by 1, 2)
select 'index' as kind, 'all' as name, month as day, round(ipx, 4) as value from idx union all select 'brent', 'brent', since, round(price, 4) from o union all select 'usd_rub', 'usd_rub', since, round(top, 4) from o
union all select 'rate', 'rate', since, cast(month(since) as double) from o union all select 'dividends', cast(inst as varchar), since, round(amount, 4) from dv
union all select 'capitalization', name, date '2024-01-01', round(cap, 4) from dim
""")
def landed_series(spark, sf):
    """Index, oil, currency, rate, dividends and capitalization, each landed in another format, read with its own schema."""
    o = i.table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("at")).agg(F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("top"))
    x = F.lit("all").alias("ticker"), F.col("month").alias("ts"), *(F.col("ipx").alias(c) for c in ("open", "high", "low", "close")), F.lit(0.0).alias("volume")
    dv = i.table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.date_trunc("month", "l_shipdate").cast("date").alias("date")).agg(F.sum("l_tax").alias("amount"))
    tables = {
        "index": (land(i.index(spark, sf).select(*x), "index", "json"), "ticker", "ts", "close"),
        "brent": (land(o.select(F.lit("brent").alias("series"), F.col("at").alias("ts"), F.col("price").alias("value")), "brent", "csv"), "series", "ts", "value"),
        "usd_rub": (land(o.select(F.lit("usd_rub").alias("series"), F.col("at").alias("ts"), F.col("top").alias("value")), "usd_rub", "orc"), "series", "ts", "value"),
        "rate": (land(o.select(F.col("at").alias("effective_date"), F.month("at").alias("rate")), "rate", "csv").withColumn("name", F.lit("rate")), "name", "effective_date", "rate"),
        "dividends": (land(dv, "dividends", "orc"), "ticker", "date", "amount"),
        "capitalization": (land(i.dimension(spark, sf).select(F.col("name").alias("ticker"), F.lit("2024-01-01").cast("date").alias("date"), "cap"), "capitalization", "json"), "ticker", "date", "cap"),
    }
    out = None
    for kind, (df, name, day, value) in tables.items():
        one = df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(day).cast("date").alias("day"), F.round(value, 4).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select kind as source_kind, source, count(*) as n, cast(sum(length(text)) as bigint) as n_chars, min(published) as first, max(published) as last from stories group by 1, 2")
def landed_messages(spark, sf):
    """Messages of channels and feeds as JSON lines, a file a partition, through the engine's own data source."""
    landed.register(spark)
    out = None
    for kind in ("tg", "media"):
        path = fresh(spark, f"landed-{kind}")
        n = i.news(spark, sf).where(F.col("kind") == kind)
        n.select(F.col("news_id").alias("id"), F.col("source").alias("channel"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "text").write.json(path)
        fs, at = open_fs(path)
        scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
        files = [scheme + f.path for f in fs.get_file_info(FileSelector(at)) if f.base_name.endswith(".json") and f.size]
        read = spark.read.format("landed_messages").options(paths=",".join(files), kind=kind).load()
        out = read if out is None else out.unionByName(read)
    return out.groupBy("source_kind", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.min("published").alias("first"), F.max("published").alias("last"))


@query("select kind as source_kind, source, count(*) as n, cast(sum(length(text)) as bigint) as n_chars, min(published) as first, max(published) as last from stories where kind = 'tg' group by 1, 2")
def stream_messages(spark, sf):
    """Channels' messages as a stream with offsets: half the files are there at the first run, the others at the second, which goes on where the first has ended."""
    landed.register(spark)
    path, out, state = (fresh(spark, f"messages-{part}") for part in ("in", "out", "state"))
    n = i.news(spark, sf).where("kind = 'tg'")
    for half in (0, 1):
        n.where(F.col("news_id") % 2 == half).select(F.col("news_id").alias("id"), F.col("source").alias("channel"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "text").write.mode("append").json(path)
        stream = spark.readStream.format("landed_messages").options(path=path, kind="tg").load()
        windows.drain_into(stream, out, state)
    read = spark.read.schema(stream.schema).parquet(out)
    return read.groupBy("source_kind", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.min("published").alias("first"), F.max("published").alias("last"))


@query("select inst, month, round(px + 1e-7, 4) as px, volume from bars")
def sqlite_parts(spark, sf):
    """Monthly prices out to SQLite files, which tasks write and a list names, and in again."""
    parts.register(spark)
    path = fresh(spark, "sqlite-parts")
    i.bars(spark, sf).write.format("sqlite_parts").mode("overwrite").options(path=path, table="bars").save()
    return spark.read.format("sqlite_parts").options(path=path).load().select("inst", "month", F.round(F.col("px") + 1e-7, 4).alias("px"), "volume")


@query("select n_nationkey, n_name, r_name from nation join region on r_regionkey = n_regionkey where n_nationkey >= 0")
def sqlite_round_trip(spark, sf):
    """A small table out to SQLite and in again, a key range a partition."""
    landed.register(spark)
    fs, path = open_fs(fresh(spark, "sqlite"))
    if not isinstance(fs, LocalFileSystem):
        raise ValueError("SQLite needs a shared folder that all machines mount")
    fs.create_dir(path)
    n, r = i.table(spark, sf, "nation"), i.table(spark, sf, "region")
    small = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    landed.write_sqlite(small, f"{path}/news.db", "nations")
    return spark.read.format("sqlite_table").options(path=f"{path}/news.db", table="nations", ddl="n_nationkey int, n_name string, r_name string", rows="7").load()


@query("""
with t as (select 'N' || n_nationkey as ticker, n_name as issuer, r_name as sector, n_nationkey as k from nation join region on r_regionkey = n_regionkey union all select 'N' || n_nationkey || 'P', n_name, r_name, n_nationkey from nation join region on r_regionkey = n_regionkey where n_nationkey < 3)
select ticker, issuer, sector, count(m.news_id) as n_news from t left join (select news_id, s_nationkey from mentioned join supplier on s_suppkey = inst) m on m.s_nationkey = t.k group by 1, 2, 3
""")
def ticker_dimension(spark, sf):
    """The dimension as one JSON array under its own spelling of the key; both share classes of an issuer get the issuer's mentions."""
    n, r = i.table(spark, sf, "nation"), i.table(spark, sf, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name").collect()  # a lookup of fixed, small size
    listed = [{"tiker": f"N{x.n_nationkey}", "name": x.n_name, "sector": x.r_name} for x in rows]
    listed += [{"tiker": f"N{x.n_nationkey}P", "name": f"{x.n_name} — привилегированные", "sector": x.r_name} for x in rows if x.n_nationkey < 3]
    folder = fresh(spark, "tickers")
    fs, path = open_fs(folder)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/securities.json") as f:
        f.write(json.dumps(listed, ensure_ascii=False, indent=1).encode())
    dim = tickers.read_tickers(spark, f"{folder}/securities.json")
    said = i.mentions(spark, sf).join(i.dimension(spark, sf).select("inst", F.col("sector").alias("issuer")), "inst")
    return dim.join(said, "issuer", "left").groupBy("ticker", "issuer", dim.sector).agg(F.count("news_id").alias("n_news"))
