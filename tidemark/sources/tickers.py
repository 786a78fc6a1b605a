"""The security dimension: a JSON array of ``tiker`` (sic), ``name``, ``sector``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, name, sector, issuer``. The array spans lines, so line-wise reading would lose it.

    Preferred shares carry a suffix after a dash in their name; without it both classes share an ``issuer``.
    """
    raw = spark.read.schema("tiker string, name string, sector string").option("multiLine", True).json(path)
    issuer = F.trim(F.regexp_replace("name", r"\s+[—–-]\s+\p{L}+$", ""))
    return raw.select(F.col("tiker").alias("ticker"), "name", "sector", issuer.alias("issuer"))
