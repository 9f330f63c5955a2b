"""Streaming forms of the event aggregations: watermarks bound the state, late rows drop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The events of a folder as a stream, new files a trigger."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(hour, event_type, n, total) of each window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): visits of a user parted by a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once, as far back as the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_counts(events: DataFrame) -> DataFrame:
    """(user_id, n, last): a count of each user's events kept as custom state."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        n, last = state.get if state.exists else (0, pd.Timestamp(0))
        for f in frames:
            n += len(f)
            last = max(last, f["ts"].max())
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [last]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, last timestamp", "n bigint, last timestamp", "update", GroupStateTimeout.NoTimeout)
