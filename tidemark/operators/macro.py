"""Macro and geopolitical news: classification behind a model boundary, and signals out of the model's JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.inference import Model, over_batches
from tidemark.schemas import SIGNAL

SCOPES = ("market", "sector")
# The stand-in's rules: class, pattern. A language model takes the place of ``rule_classifier``.
RULES = (("geo", r"санкц|войн|sanction|conflict"), ("macro", r"ставк|инфляц|ввп|rate|inflation|gdp"))
# Sectors of the exchange and beginnings of words that speak of one.
SECTORS = {"Нефть и газ": ("нефт", "газ", "oil"), "Банки": ("банк", "кредит", "bank"), "Металлургия": ("сталь", "металл", "steel"), "Энергетика": ("энерг", "электр"), "Ритейл": ("ритейл", "магазин", "retail"), "Телеком": ("телеком", "связ", "telecom"), "Технологии": ("технолог", "software"), "Девелопмент": ("жиль", "ипотек", "mortgage")}


def rule_classifier(text: str, sectors: Mapping[str, Sequence[str]] = SECTORS) -> str:
    """JSON as a model would answer: class, scope, sector, tickers. News that speaks of one sector alone is about it, all other about the market."""
    low = text.lower()
    kind = next((k for k, p in RULES if re.search(p, low)), "other")
    named = [s for s, begins in sectors.items() if re.search(r"\b(?:" + "|".join(map(re.escape, begins)) + ")", low)]
    sector = named[0] if len(named) == 1 else None
    return json.dumps({"class": kind, "scope": "sector" if sector else "market", "sector": sector, "tickers": re.findall(r"\$([A-Z]{1,5})\b", text)})


def load_rules(sectors: Mapping[str, Sequence[str]] = SECTORS) -> Model:
    """The stand-in behind the boundary; a language model's loader takes its place."""
    return lambda texts: [rule_classifier(t, sectors) for t in texts]


def classify(news: DataFrame, text: str, load: Callable[[], Model] = load_rules, batch: int = 64) -> DataFrame:
    """Adds ``answer``, the model's raw JSON; null for a text it cannot answer."""
    run = over_batches(load, None, batch)

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for got in run(batches):
            yield pd.Series(got, dtype=object)

    return news.withColumn("answer", answer(text))


def signals(answers: DataFrame, answer: str, securities: DataFrame) -> DataFrame:
    """Adds ``signal``; null unless the JSON parses and the scope is known. Tickers outside the dimension are dropped from its list.

    Lists are looked up once each, a ticker a row, so the dimension may have any size: nothing of it is packed into one value.
    """
    parsed = answers.withColumn("_s", F.from_json(answer, SIGNAL)).withColumn("_listed", F.when(F.size("_s.tickers") > 0, F.col("_s.tickers")))
    lists = parsed.where("_listed is not null").select("_listed").distinct()
    known = lists.select("_listed", F.explode("_listed").alias("ticker")).join(securities.select("ticker"), "ticker", "left_semi").groupBy("_listed").agg(F.collect_set("ticker").alias("_known"))
    parsed = parsed.join(known, "_listed", "left")
    valid = F.col("_s.scope").isin(*SCOPES) & ((F.col("_s.scope") == "market") | F.col("_s.sector").isNotNull())
    kept = F.coalesce(F.array_intersect("_listed", "_known"), F.array().cast("array<string>"))
    signal = F.when(valid, F.struct(F.col("_s.class").alias("class"), F.col("_s.scope").alias("scope"), F.col("_s.sector").alias("sector"), kept.alias("tickers")))
    return parsed.select(*answers.columns, signal.alias("signal"))


def only_macro(signalled: DataFrame) -> DataFrame:
    return signalled.where(F.col("signal.class").isin("macro", "geo"))


def by_scope(signalled: DataFrame, date: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The branches of scored macro and geopolitical news: market-wide sentiment by date, and a sector's by date and sector.

    ``market_sent`` and ``sector_sent`` are read from these: other news, and news of the other scope, have no part in them.
    """
    from tidemark.operators.sentiment import aggregate

    macro = only_macro(signalled).withColumn("sector", F.col("signal.sector"))
    market, sector = macro.where("signal.scope = 'market'"), macro.where("signal.scope = 'sector'")
    return aggregate(market, [date], value), aggregate(sector, [date, "sector"], value)
