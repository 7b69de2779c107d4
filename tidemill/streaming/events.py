"""Structured Streaming over files of events (beyond the dialect's own operators)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.files import scratch


def stream_table(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream: each file that appears in the folder is read once."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tumbling(events: DataFrame, size: str, late: str, *aggregates) -> DataFrame:
    return _windowed(events, F.window("ts", size), late, *aggregates)


def sliding(events: DataFrame, size: str, slide: str, late: str, *aggregates) -> DataFrame:
    return _windowed(events, F.window("ts", size, slide), late, *aggregates)


def sessions(events: DataFrame, gap: str, late: str, *aggregates) -> DataFrame:
    """Sessions by user: a gap without events ends one."""
    return _windowed(events, F.session_window("ts", gap), late, *aggregates, keys=("user_id",))


def _windowed(events: DataFrame, window, late: str, *aggregates, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in grouped.columns if c not in {"w", *keys}])


def deduplicated(events: DataFrame, late: str, *keys: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return the result table."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")
    if mode == "append":
        done = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        done.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    name = f"drained_{uuid.uuid4().hex}"
    done = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.table(name)


def for_each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Stream to relation: each micro-batch as a table."""
    state = scratch(stream.sparkSession, "batches")
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
