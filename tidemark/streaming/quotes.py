"""A streaming as-of join: news with the last quote at or before them, as soon as the watermark says that no earlier quote can still come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKETS = 256  # of keys, whatever their number; the state of streams already running is kept by them
CHUNK_ROWS = 1 << 18


class LastQuote(StatefulProcessor):
    """Of each bucket of keys: quotes, and news that wait for the watermark. A timer behind the earliest row answers what is due, drops quotes that no later news can ask for, and sets the next.

    What is kept of a key is one quote and what came since the watermark, however long the stream runs; of a bucket, besides, up to where quotes have been dropped, as rows
    from before come too late. A call of the state costs more than the join of many rows, so rows come and stay in chunks, and a bucket answers all its keys at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quotes = handle.getListState("quotes", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.dropped = handle.getValueState("dropped", "before long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        gone, first = self.dropped.get(), []
        for frame in rows:
            chunks = {True: [], False: []}
            for quote, earliest, chunk in frame[["quote", "earliest", "rows"]].itertuples(index=False):
                if gone is not None and earliest < gone[0]:
                    timely = opened([chunk]).filter(pc.field("at") >= gone[0])
                    if not len(timely):
                        continue
                    chunk, earliest = closed(timely), pc.min(timely["at"]).as_py()
                chunks[quote].append((bytes(chunk),))
                first.append(int(earliest))
            for quote, state in ((True, self.quotes), (False, self.waiting)):
                if chunks[quote]:
                    state.appendList(chunks[quote])
        if first:
            self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        quotes, news = (opened([r[0] for r in state.get()]) for state in (self.quotes, self.waiting))
        if news is not None:
            due = pc.less(news["at"], mark)
            if pc.any(due).as_py():
                yield answered(quotes, news.filter(due))
                news = news.filter(pc.invert(due))
                self._put(self.waiting, news)
        if quotes is not None:
            quotes = needed(quotes, mark)
            self._put(self.quotes, quotes)
        self.dropped.update((mark,))
        ahead = [pc.min(t["at"].filter(pc.greater_equal(t["at"], mark))).as_py() for t in (quotes, news) if t is not None]
        if any(at is not None for at in ahead):
            self._wake(min(at for at in ahead if at is not None))

    def _wake(self, at: int) -> None:
        """At the first millisecond behind ``at``."""
        self.handle.registerTimer(at // 1000 + 1)

    @staticmethod
    def _put(state, rows: pa.Table) -> None:
        if len(rows):
            state.put([(closed(rows),)])
        else:
            state.clear()

    def close(self) -> None:
        pass


def closed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def opened(chunks: list[bytes]) -> pa.Table | None:
    return pa.concat_tables([pa.ipc.open_stream(bytes(c)).read_all() for c in chunks]).combine_chunks() if chunks else None


def in_order(keys: list[pa.ChunkedArray], *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the keys of all tables, one after the other, and the order of their rows by key and by ``by``, the most important last."""
    codes = pa.concat_arrays([c for k in keys for c in k.chunks]).dictionary_encode().indices.to_numpy()
    return codes, np.lexsort((*by, codes))


def needed(quotes: pa.Table, mark: int) -> pa.Table:
    """Quotes from ``mark`` on, and of each key the last before it; of several quotes of one time the largest."""
    at = quotes["at"].to_numpy()
    codes, order = in_order([quotes["key"]], quotes["value"].to_numpy(), at)
    codes, at = codes[order], at[order]
    another = codes[1:] != codes[:-1]
    last = np.append(another | (at[1:] != at[:-1]) & (at[1:] >= mark), True)
    return quotes.take(order[last])


def answered(quotes: pa.Table | None, news: pa.Table) -> pd.DataFrame:
    """``news`` with the last of ``quotes`` not after them, the largest of its time."""
    quotes = news.schema.empty_table().select(["key", "at"]).append_column("value", pa.array([], pa.float64())) if quotes is None else quotes
    n, m = len(quotes), len(news)
    at, value = np.append(quotes["at"].to_numpy(), news["at"].to_numpy()), np.append(quotes["value"].to_numpy(), np.zeros(m))
    codes, order = in_order([quotes["key"], news["key"]], value, np.repeat([0, 1], [n, m]), at)
    place = np.maximum.accumulate(np.where(order < n, np.arange(n + m), 0))
    found = np.empty(n + m, np.int64)
    found[order] = order[place]
    k = found[n:]
    none = (k >= n) | (codes[k] != codes[n:])
    nullable = lambda x, missing: pd.arrays.IntegerArray(x.astype(np.int64), missing)
    out = {"key": news["key"].to_pylist(), "id": nullable(news["id"].fill_null(0).to_numpy(), news["id"].is_null().to_numpy()), "at": at[n:], "asof_at": nullable(at[k], none)}
    # A frame's NaN comes out as null, so a quote that is none is told apart.
    return pd.DataFrame(out | {"nan": np.isnan(value[k]) & ~none, "value": np.where(none, np.nan, value[k])})


def in_chunks(rows: DataFrame, quote: bool) -> DataFrame:
    """``bucket, _t, quote, earliest, rows``: a chunk for each bucket of every ``CHUNK_ROWS`` rows of a partition, with its latest and its earliest time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield chunked(held)
                held, n = [], 0
        if n:
            yield chunked(held)

    def chunked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("bucket").combine_chunks()
        bucket, at = table["bucket"].to_numpy(), table["at"].to_numpy()
        starts = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
        rows = table.drop_columns("bucket")
        chunks = [closed(rows.slice(a, b - a)) for a, b in zip(starts, np.append(starts[1:], len(table)))]
        latest = pa.array(np.maximum.reduceat(at, starts)).cast(pa.timestamp("us", "UTC"))
        out = [pa.array(bucket[starts]), latest, pa.array([quote] * len(starts)), pa.array(np.minimum.reduceat(at, starts)), pa.array(chunks, pa.binary())]
        return pa.RecordBatch.from_arrays(out, names=["bucket", "_t", "quote", "earliest", "rows"])

    return rows.mapInArrow(run, "bucket int, _t timestamp, quote boolean, earliest long, rows binary")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def asof_stream(news: DataFrame, quotes: DataFrame, by: str, news_id: str, news_ts: str, quote_ts: str, value: str, delay: str) -> DataFrame:
    """Streams of ``news`` and ``quotes`` to ``by, news_id, news_ts``, ``asof_`` and the quote's time, and ``asof_`` and its value (a double).

    Equal times count as known, and of several quotes of one time the largest counts, as in ``asof.asof_join``; news before any quote have nulls.
    A row comes out when both streams have passed it by ``delay`` (the watermark is the slower stream's), so every row is the
    batch join's. Rows that come later than ``delay`` are dropped; those with a null key, time or value take no part.
    """
    keyed = lambda df, t, name, c: df.where(F.col(by).isNotNull() & F.col(t).isNotNull()).select(
        F.pmod(F.xxhash64(by), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col(by).alias("key"), F.unix_micros(F.col(t).cast("timestamp")).alias("at"), c.alias(name)
    )
    n = keyed(news, news_ts, "id", F.col(news_id).cast("long"))
    q = keyed(quotes.where(F.col(value).isNotNull()), quote_ts, "value", F.col(value).cast("double"))
    both = in_chunks(n, False).withWatermark("_t", delay).unionByName(in_chunks(q, True).withWatermark("_t", delay))
    out = StructType([StructField("key", n.schema["key"].dataType)] + [StructField(c, LongType()) for c in ("id", "at", "asof_at")] + StructType.fromDDL("nan boolean, value double").fields)
    found = both.groupBy("bucket").transformWithStateInPandas(LastQuote(), out, "Append", "EventTime")
    found = found.withColumn("value", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("value")))
    return found.select(F.col("key").alias(by), F.col("id").alias(news_id), F.timestamp_micros("at").alias(news_ts), F.timestamp_micros("asof_at").alias(f"asof_{quote_ts}"), F.col("value").alias(f"asof_{value}"))
