"""Streams against batches: as-of joins by state and timers, landed messages by offsets."""

import json
import sqlite3
from datetime import date, datetime, timedelta
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException, StreamingQueryException

from tidemark.operators.asof import asof_join
from tidemark.sources import landed, sqlite_parts
from tidemark.streaming import quotes, windows
from tidemark.work import fresh

START = datetime(2024, 1, 1)
NEWS, QUOTES = "news_id long, inst string, at timestamp", "inst string, seen timestamp, px double, note string"


def at(minute):
    return START + timedelta(minutes=minute)


def test_asof_stream_equals_the_batch_join(spark, tmp_path):
    """Over two runs of one stream: state carries quotes over, ties take the largest, keys without quotes get nulls, and what the watermark has not passed waits."""
    folders = {k: str(tmp_path / k) for k in ("news", "quotes")}
    out, state = fresh(spark, "asof"), fresh(spark, "asof-state")
    parts = [
        ([(1, "a", at(5)), (2, "a", at(10)), (3, "b", at(10)), (4, None, at(3)), (5, "a", None), (6, "c", at(0))], [("a", at(6), 1.0, ""), ("a", at(10), 2.0, ""), ("a", at(10), 3.0, ""), ("b", at(1), None, ""), ("z", at(40), 9.0, "")]),
        ([(7, "a", at(60)), (7, "a", at(60)), (8, "b", at(61)), (9, "a", at(200))], [("a", at(61), 4.0, ""), ("b", at(61), 5.0, ""), ("b", at(50), 6.0, ""), ("z", at(200), 9.0, "")]),
    ]
    news, marks = [], []
    for n, q in parts:
        spark.createDataFrame(n, NEWS).coalesce(1).write.mode("append").parquet(folders["news"])
        spark.createDataFrame(q, QUOTES).coalesce(1).write.mode("append").parquet(folders["quotes"])
        streams = {k: spark.readStream.schema(s).parquet(folders[k]) for k, s in (("news", NEWS), ("quotes", QUOTES))}
        joined = quotes.asof_stream(streams["news"], streams["quotes"], "inst", "news_id", "at", "seen", "px", "5 minutes")
        with quotes.rocksdb(spark):
            windows.drain_into(joined, out, state)
        news += n
        marks.append(sorted(r.news_id for r in spark.read.schema(joined.schema).parquet(out).collect()))
    # The first watermark is five minutes behind the slower stream's ten: story 1 stands on it and is not passed yet.
    assert marks == [[6], [1, 2, 3, 6, 7, 7, 8]]
    want = asof_join(spark.read.parquet(folders["news"]).where("inst is not null and at is not null"), spark.read.parquet(folders["quotes"]).where("px is not null"), ["inst"], "at", "seen", ["px"])
    got = spark.read.schema(joined.schema).parquet(out).select("news_id", "inst", "at", "asof_seen", "asof_px").collect()
    assert sorted(map(repr, got)) == sorted(repr(r) for r in want.select("news_id", "inst", "at", "asof_seen", "asof_px").collect() if r.news_id != 9)


def test_asof_state_holds_chunks_of_buckets(spark):
    """A batch calls the state once a bucket, not once a key; ties, null ids, unmatched news and NaN come out as the batch join's."""
    rows = spark.range(0, 40_000, 1, 2).selectExpr(f"cast(pmod(id, {quotes.BUCKETS}) as int) as bucket", "concat('k', id) as key", "id as at", "id / 2 as value")
    chunks = quotes.in_chunks(rows, True).collect()
    assert len(chunks) <= 2 * quotes.BUCKETS
    for c in chunks:
        own = quotes.opened([c.rows]).to_pydict()
        assert {int(k[1:]) % quotes.BUCKETS for k in own["key"]} == {c.bucket} and c.earliest == min(own["at"])
    assert sum(len(quotes.opened([c.rows])) for c in chunks) == 40_000
    q = pa.table({"key": ["a", "a", "a", "b", "b", "c"], "at": [1, 5, 5, 4, 9, 8], "value": [1.0, 3.0, 2.0, 1.0, float("nan"), 7.0]})
    assert sorted(quotes.needed(q, 6).select(["key", "at"]).to_pylist(), key=str) == [{"key": "a", "at": 5}, {"key": "b", "at": 4}, {"key": "b", "at": 9}, {"key": "c", "at": 8}]
    got = quotes.answered(q, pa.table({"key": ["a", "a", "b", "c", "d"], "at": [5, 0, 10, 7, 9], "id": pa.array([2**53 + 1, 2, None, 4, 5])}))
    assert got["id"].tolist() == [2**53 + 1, 2, pd.NA, 4, 5] and got["asof_at"].tolist() == [5, pd.NA, 9, pd.NA, pd.NA]
    assert got["nan"].tolist() == [False, False, True, False, False] and got["value"][0] == 3.0


def line(n):
    return json.dumps({"id": n, "channel": "c", "date": "2024-01-01T10:00:00", "text": f"слово {n}" * (n % 7)}, ensure_ascii=False) + "\n"


def test_messages_arrive_once(spark, tmp_path):
    """Files that grow, come and go between runs, a line half written, and cuts inside lines: each whole line is read exactly once."""
    landed.register(spark)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("landed_messages").options(path=str(folder), kind="tg", split="50").load()
        windows.drain_into(stream, out, state)
        return sorted(r.news_id for r in spark.read.schema(stream.schema).parquet(out).collect())

    (folder / "a.jsonl").write_text("".join(map(line, range(20))) + line(20)[:15])
    (folder / "_b.jsonl").write_text(line(99))
    (folder / "empty.jsonl").write_text("")
    assert run() == list(range(20))
    assert run() == list(range(20))
    with (folder / "a.jsonl").open("a") as f:
        f.write(line(20)[15:] + "\n" + line(21))
    (folder / "c.jsonl").write_text("".join(map(line, range(22, 40))))
    assert run() == list(range(40))
    (folder / "c.jsonl").unlink()
    (folder / "d.jsonl").write_text(line(40))
    assert run() == list(range(41))
    (folder / "a.jsonl").write_text(line(0))
    with pytest.raises(StreamingQueryException, match="shrunk"):
        run()


ODD = "k long, ok boolean, day date, at timestamp_ntz, d decimal(10,2), x double, t string, b binary"


def test_sqlite_parts(spark, tmp_path):
    """All plain types and nulls come back; a file has no more rows than asked; only listed files count; overwriting leaves none behind."""
    sqlite_parts.register(spark)
    path = str(tmp_path / "db")
    data = [(n, n % 2 == 0, date(2024, 1, 1), datetime(2024, 1, 1, 1, 2, 3, 4), Decimal("1.50"), 0.1 * n, 'a"b', bytearray(b"\x00")) for n in range(25)] + [(None,) * 8]
    df = spark.createDataFrame(data, ODD).repartition(2)
    save = lambda df, mode: df.write.format("sqlite_parts").mode(mode).options(path=path, table='odd "name', rows="10").save()
    load = lambda: spark.read.format("sqlite_parts").options(path=path).load()
    save(df, "append")
    assert load().schema == df.schema and sorted(map(repr, load().collect())) == sorted(map(repr, df.collect()))
    files = [f for f in (tmp_path / "db").iterdir() if f.suffix == ".db"]
    assert len(files) >= 3 and sum(sqlite3.connect(f).execute('select count(*) from "odd ""name"').fetchone()[0] for f in files) == 26
    (tmp_path / "db" / "part-stray.db").write_bytes(files[0].read_bytes())
    save(df.limit(3), "append")
    assert load().count() == 29
    with pytest.raises(Exception, match="name and schema"):
        save(df.select("k"), "append")
    assert load().count() == 29
    save(df.where("k < 0"), "overwrite")
    assert load().collect() == [] and [f.name for f in (tmp_path / "db").iterdir() if f.suffix == ".db"] == ["part-stray.db"]
    with pytest.raises((AnalysisException, ValueError), match="take apart"):
        save(spark.sql("select array(1) as a"), "overwrite")
