"""Event streams: windows, sessions, late data, change feeds and incremental compiles.

Each function takes a batch or a streaming DataFrame of ``events``; the batch
result is what the stream adds up to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: columns of the event feed.
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events and values by window and type."""
    each = _late(events, delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return each.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    each = _late(events, delay).groupBy(F.window("ts", width, step).alias("w"))
    return each.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    each = _late(events, delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return each.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def deduplicated(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Events once by id, with bounded state on a stream."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def enriched(events: DataFrame, users: DataFrame) -> DataFrame:
    """Stream-static join with a dimension by user."""
    return events.join(users, "user_id", "left")


def changes(events: DataFrame, to: Callable[[DataFrame, int], None]):
    """A change feed: each micro-batch goes to ``to`` once."""
    return events.writeStream.foreachBatch(to).trigger(availableNow=True)


def incremental_compile(spark: SparkSession, folder: str, schema: str, checkpoint: str, compile_batch: Callable[[DataFrame, int], None]):
    """Compile new files of a folder exactly once, then stop."""
    new = spark.readStream.schema(schema).parquet(folder)
    return new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(compile_batch).trigger(availableNow=True).start()
