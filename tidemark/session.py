"""Session settings that the engine's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps date truncation equal in every engine; AQE picks joins, coalesces partitions and splits skewed ones at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str | None = None, app: str = "tidemark", **more: str) -> SparkSession:
    """A session with ``SETTINGS``; ``more`` overrides (``shuffle_partitions="8"`` stands for ``spark.sql.shuffle.partitions``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    named = {"spark.sql.shuffle.partitions": more.pop("shuffle_partitions")} if "shuffle_partitions" in more else {}
    for k, v in (SETTINGS | named | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
