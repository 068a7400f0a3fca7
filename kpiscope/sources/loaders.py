"""Loaders of the seven source tables: typed reads with the quality rules of each applied."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.operators import quality as q


def orders(raw: DataFrame) -> DataFrame:
    """Quarantine flags on all versions, then the newest version of each day, region and line."""
    got = q.flag(q.flag(raw, q.missing("discounts")), q.negative("units_shipped"))
    got = q.latest(got, ("date", "region", "product_line"), [F.desc("ingested_at"), F.desc("source_row_id")])
    return got.withColumns({"arrival_lag_days": q.arrival_lag(F.col("ingested_at"), F.col("date")), "is_late": q.late(F.col("ingested_at"), F.col("date"))})


def order_defects(raw: DataFrame) -> DataFrame:
    """ERP-001..004 over all versions."""
    key = ("date", "region", "product_line")
    extra = raw.join(q.duplicates(raw, key, "gross_sales").select(*key, F.lit(True).alias("_dup")), list(key), "left")
    out = q.defect(raw, "ERP-001", "MISSING_VALUE", "MEDIUM", "QUARANTINE", q.missing("discounts"))
    for part in (
        q.defect(raw, "ERP-002", "SIGN_ERROR", "HIGH", "QUARANTINE", q.negative("units_shipped")),
        q.defect(extra, "ERP-003", "DUPLICATE_CONFLICT", "HIGH", "LATEST_INGEST_WINS", F.coalesce("_dup", F.lit(False))),
        q.defect(raw, "ERP-004", "LATE_ARRIVAL", "LOW", "FLAG", q.late(F.col("ingested_at"), F.col("date"))),
    ):
        out = out.unionByName(part)
    return out


def refunds(raw: DataFrame) -> DataFrame:
    """The newest version by the text of the ingest time."""
    return q.latest(raw, ("date", "region", "product_line"), [F.col("ingested_at").cast("string").desc(), F.desc("source_row_id")])


def marketing(raw: DataFrame) -> DataFrame:
    return raw.withColumn("week_start", F.date_trunc("week", "week_start").cast("date"))


def marketing_gaps(raw: DataFrame, regions: DataFrame) -> DataFrame:
    """MKT-001: expected regions without any row."""
    return q.absent_members(regions, raw, "region")


def dispatch(raw: DataFrame) -> DataFrame:
    ts = q.normalise_timestamp(F.col("ts_raw"))
    got = raw.withColumns({"ts": ts, "convention": q.timestamp_convention(F.col("ts_raw")), "date": F.to_date(F.from_utc_timestamp(ts, q.IST))})
    got = q.flag(got, q.missing("actual_hours"))
    return got.withColumn("sla_met", F.when(F.col("actual_hours").isNotNull(), F.col("actual_hours") <= F.col("promised_hours")))


def tickets(raw: DataFrame, end: dt.date) -> DataFrame:
    return raw.withColumn("future_dated", q.future_dated(F.col("date"), F.col("ingested_at"), end))


def external(raw: DataFrame) -> DataFrame:
    return raw


def external_coverage(raw: DataFrame, start: dt.date, end: dt.date, lines: Sequence[str]) -> DataFrame:
    """EXT-001: percent of the day x line grid with a row."""
    n = max(1, ((end - start).days + 1) * len(lines))
    return q.grid_coverage(raw, ("date", "product_line"), F.lit(n))


def period_end(df: DataFrame, column: str, extra_days: int = 0) -> DataFrame:
    """The last business date a source covers; a weekly feed covers six days more."""
    return df.agg(F.date_add(F.max(column), extra_days).alias("period_end"))


