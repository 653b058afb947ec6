"""Extensions: the query log and file changes as streams. The operators they call are those of the batch side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def log_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(event_type, start, n, total) in tumbling windows of events (ts, event_type, value); rows later than late are dropped once
    their window has closed. As a batch, nothing is late."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if events.isStreaming else e
    g = e.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events (ts, user_id) with less than gap between them."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if events.isStreaming else e
    g = e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event_id once, however often it is sent within late."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def follow(changes: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls refresh(changes, batch number) for every batch of a stream of file changes, such as one that brings an index up to date.

    A batch may be given again after a failure, with the same number: refresh must be repeatable, as an index's is. every None:
    what has arrived, then the query ends.
    """
    w = changes.writeStream.foreachBatch(lambda df, n: refresh(df, n) if df.limit(1).count() else None).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)).start()
