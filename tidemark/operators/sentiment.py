"""Sentiment: model boundaries with deterministic stand-ins, and aggregates by security, sector and market."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.inference import Model, over_batches

CLASSES = ("neg", "neu", "pos")
# The stand-in's words; a real scorer takes the place of ``word_scorer``.
GOOD, BAD = ("рост", "прибыль", "рекорд", "gain", "growth", "profit"), ("падение", "убыток", "санкции", "loss", "trash", "disgusting", "fraud")


def word_scorer(texts: pd.Series) -> pd.DataFrame:
    """Shares of good and bad words as neg, neu, pos that add up to 1."""
    low = texts.fillna("").str.lower()
    pos, neg = (sum(low.str.count(rf"\b{w}\b") for w in words) for words in (GOOD, BAD))
    total = 1.0 + pos + neg
    return pd.DataFrame({"neg": neg / total, "neu": 1.0 / total, "pos": pos / total})


def load_words() -> Model:
    """The stand-in behind the boundary; the classifier's loader takes its place."""
    return lambda texts: word_scorer(pd.Series(texts, dtype=object)).to_dict("records")


def score(news: DataFrame, text: str, load: Callable[[], Model] = load_words, batch: int = 64) -> DataFrame:
    """Adds ``sentiment`` (neg, neu, pos); null for a text the model cannot score."""
    run = over_batches(load, None, batch)

    @F.pandas_udf("neg double, neu double, pos double")
    def sentiment(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for got in run(batches):
            yield pd.DataFrame([g or dict.fromkeys(CLASSES) for g in got], columns=list(CLASSES), dtype=float)

    scored = news.withColumn("sentiment", sentiment(text))
    return scored.withColumn("sentiment", F.when(F.col("sentiment.neu").isNotNull(), F.col("sentiment")))


def net(sentiment: str) -> Column:
    return F.col(f"{sentiment}.pos") - F.col(f"{sentiment}.neg")


def label(neg: Column, neu: Column, pos: Column) -> Column:
    """The largest class; ties go to neutral, then to negative."""
    top = F.greatest(neg, neu, pos)
    return F.when(neu == top, "neu").when(neg == top, "neg").otherwise("pos")


def aggregate(scored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and the means of the negative and the positive side, for any grouping (security, sector, market)."""
    v = F.col(value)
    return scored.groupBy(*keys).agg(F.count(v).alias("n_news"), F.avg(v).alias("sent"), F.sum(F.when(v < 0, 1).otherwise(0)).alias("n_neg"), F.sum(F.when(v > 0, 1).otherwise(0)).alias("n_pos"))


def spread_scopes(panel: DataFrame, market: DataFrame, sector: DataFrame, date: str, sector_key: str) -> DataFrame:
    """Panel rows with ``market_sent`` of their date and ``sector_sent`` of their date and sector; days without news are neutral."""
    m = market.select(date, F.col("sent").alias("market_sent"))
    s = sector.select(date, sector_key, F.col("sent").alias("sector_sent"))
    return panel.join(m, date, "left").join(s, [date, sector_key], "left").fillna(0.0, ["market_sent", "sector_sent"])
