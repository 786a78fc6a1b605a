"""Streaming forms of the event aggregates. NTZ times are cast to instants, as watermarks need them."""

from __future__ import annotations

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.work import fresh, open_fs

DELAY = "10 minutes"


def open_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream over landed event files of the table's own schema. ``path`` is a folder, or one file, which streams need a folder for."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    fs, at = open_fs(path)
    if fs.get_file_info(at).type == FileType.File:
        folder, name = path.rsplit("/", 1)
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str, keys: list[str], delay: str = DELAY) -> DataFrame:
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", length), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, length: str, slide: str, keys: list[str], delay: str = DELAY) -> DataFrame:
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, delay: str = DELAY) -> DataFrame:
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run all available input through a file sink in the shared folder and read the result."""
    spark = stream.sparkSession
    out, state = fresh(spark, name), fresh(spark, f"{name}-state")
    drain_into(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


def drain_into(stream: DataFrame, out: str, state: str) -> None:
    """Run what is available now into files at ``out``. The next call with the same ``state`` goes on where this one has ended, or was cut off: the sink takes each batch once."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
