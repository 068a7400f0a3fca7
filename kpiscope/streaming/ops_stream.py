"""Streaming: deduplicated event-time windows and idempotent upserts.

An extension beyond the batch engine: the batch lateness rule becomes a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """Event files as a stream. Event time must be an instant, so NTZ times are cast."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, lateness: str = "2 days", size: str = "1 day", slide: str | None = None, dedupe: bool = True) -> DataFrame:
    """Count and sum of each event type in tumbling (or sliding) windows; repeated ids within
    the watermark count once, later rows are dropped and reported by the query's progress."""
    got = events.withWatermark("ts", lateness)
    if dedupe:
        got = got.dropDuplicatesWithinWatermark(["event_id"])
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = got.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, lateness: str = "2 days", gap: str = "30 minutes") -> DataFrame:
    """Each user's runs of events less than ``gap`` apart. Over a table the lateness has no effect."""
    got = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch under its number; a repeated batch overwrites itself, and readers
    take the newest batch of each key (``read_upserts``)."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_upserts(spark: SparkSession, path: str, keys: tuple[str, ...] = ("window_start", "event_type")) -> DataFrame:
    got = spark.read.option("recursiveFileLookup", True).parquet(path)
    others = [c for c in got.columns if c not in keys and c != "batch"]
    newest = got.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in others])


def drain(stream: DataFrame, path: str, keys: tuple[str, ...] = ("window_start", "event_type")) -> DataFrame:
    """Upsert all that is there into tables under ``path`` and read them back; nothing passes the
    driver."""
    upsert(stream, f"{path}/rows", f"{path}/progress").awaitTermination()
    return read_upserts(stream.sparkSession, f"{path}/rows", keys)
