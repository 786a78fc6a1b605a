"""Explicit schemas of the engine's inputs. The inputs' own layouts are not published, so these are ours."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, D, DAY, TS = T.StringType(), T.DoubleType(), T.DateType(), T.TimestampNTZType()

SECURITY = _struct(ticker=S, name=S, sector=S)
CANDLE = _struct(ticker=S, ts=TS, open=D, high=D, low=D, close=D, volume=D)
SERIES = _struct(series=S, ts=TS, value=D)  # an index, oil, a currency
RATE = _struct(effective_date=DAY, rate=D)
DIVIDEND = _struct(ticker=S, date=DAY, amount=D)
CAPITALIZATION = _struct(ticker=S, date=DAY, cap=D)
NEWS = _struct(news_id=T.LongType(), source_kind=S, source=S, published=TS, text=S)
MENTION = _struct(news_id=T.LongType(), ticker=S)
SENTIMENT = _struct(neg=D, neu=D, pos=D)
SIGNAL = T.StructType([T.StructField("class", S), T.StructField("scope", S), T.StructField("sector", S), T.StructField("tickers", T.ArrayType(S))])
EMBEDDING = _struct(news_id=T.LongType(), embedding=T.ArrayType(T.FloatType()))


def conform(df, schema: T.StructType):
    """The columns of ``schema`` in order, cast; a missing one is an error by name."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schema))
