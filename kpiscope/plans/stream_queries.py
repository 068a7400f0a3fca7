"""Event-time queries over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.plans import model as m
from kpiscope.plans.registry import registry
from kpiscope.sources.files import scratch_path
from kpiscope.streaming import ops_stream
from kpiscope.streaming.audit import AuditTable

QUERIES, SQL = {}, {}
query = registry(QUERIES, SQL)


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM events GROUP BY 1, 2""")
def stream_ops_window(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows by a drained stream, equal to the batch aggregate."""
    raw = spark.readStream.schema(ops_stream.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    got = ops_stream.drain(ops_stream.windowed(events, lateness="60 days"), scratch_path(spark, "stream"))
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
g AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM g GROUP BY user_id, run""")
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's sessions over the whole table; users have a few events a day."""
    got = ops_stream.sessions(m.t(spark, sf, "events"), gap="12 hours")
    return got.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("session_start", "session_end")], "n")


def _audited(spark: SparkSession, sf: str) -> AuditTable:
    """Events as decisions on requests: errors are refusals; appended by a stream, and once more by hand."""
    raw = spark.readStream.schema(ops_stream.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = raw.select(
        F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("request_id"), F.lit("user").alias("persona"), F.col("event_type").alias("action"),
        (F.col("event_type") != "error").alias("granted"), F.when(F.col("event_type") == "error", "REFUSED").otherwise("OK").alias("code"), F.col("event_id").cast("string").alias("detail"),
    )
    table = AuditTable(scratch_path(spark, "audit"))
    table.run(rows).awaitTermination()
    table.append(table.events(spark), 0)  # the first batch again: it adds nothing
    return table


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'R' || user_id AS request_id, event_type AS action, event_type <> 'error' AS granted, CAST(event_id AS VARCHAR) AS detail FROM events ORDER BY ts DESC, 'R' || user_id DESC, event_type DESC, CAST(event_id AS VARCHAR) DESC LIMIT 50""")
def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last 50 decisions of an audit table that a stream filled."""
    got = _audited(spark, sf).tail(spark)
    return got.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "request_id", "action", "granted", "detail")


@query("SELECT 'R' || user_id AS request_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events WHERE event_type = 'error' GROUP BY user_id")
def audit_denials(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals of each request."""
    got = _audited(spark, sf).denials(spark).groupBy("request_id").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    return got.withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))
