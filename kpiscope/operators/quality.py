"""Data quality: flags, duplicates, late and future rows, timestamps, coverage, freshness.

A defect never removes a row silently: rows are flagged, counted and kept, and what is dropped
(superseded versions) follows a stated rule.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IST = "Asia/Kolkata"
SEVERITIES = ("LOW", "MEDIUM", "HIGH")


def flag(df: DataFrame, bad: Column, name: str = "_quarantined") -> DataFrame:
    """Or a condition into the quarantine flag; unknown conditions do not flag."""
    before = F.col(name) if name in df.columns else F.lit(False)
    return df.withColumn(name, before | F.coalesce(bad, F.lit(False)))


def missing(column: str) -> Column:
    return F.col(column).isNull()


def negative(column: str) -> Column:
    return F.col(column) < 0


def duplicates(df: DataFrame, key: Sequence[str], measure: str) -> DataFrame:
    """Keys with several rows: how many, how many distinct measures, whether these conflict."""
    got = df.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct(measure).alias("n_values"))
    return got.where("n_rows > 1").withColumn("conflict", F.col("n_values") > 1)


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest row of each key. ``order`` must be total within a key; flags are set before,
    so a flagged newest row still supersedes a sound older one."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def arrival_lag(ingested: Column, date: Column) -> Column:
    """Days from the business date to the ingest date, in the session's (UTC) dates."""
    return F.datediff(F.to_date(ingested), date)


def late(ingested: Column, date: Column, most: int = 2) -> Column:
    return arrival_lag(ingested, date) > most


def future_dated(date: Column, ingested: Column, end: dt.date, zone: str = IST) -> Column:
    """After the local date of ingest, or after the history's end."""
    return (date > F.to_date(F.from_utc_timestamp(ingested, zone))) | (date > F.lit(end))


_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})$"


def timestamp_convention(raw: Column) -> Column:
    """EMPTY, EPOCH_MS, ISO_OFFSET, NAIVE_LOCAL or UNPARSEABLE."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    parsed = F.try_to_timestamp(t)
    return (
        F.when(t == "", "EMPTY")
        .when(t.rlike(r"^\d{12,}$"), "EPOCH_MS")
        .when(parsed.isNull() | ~t.rlike(r"^\d{4}-"), "UNPARSEABLE")
        .when(t.rlike(_OFFSET), "ISO_OFFSET")
        .otherwise("NAIVE_LOCAL")
    )


def normalise_timestamp(raw: Column, zone: str = IST) -> Column:
    """The instant of a raw timestamp; those without an offset are taken as local time.

    Digits of twelve places and more are epoch milliseconds; shorter ones do not parse.
    """
    t = F.trim(F.coalesce(raw, F.lit("")))
    kind = timestamp_convention(raw)
    return (
        F.when(kind == "EPOCH_MS", F.timestamp_millis(t.try_cast("bigint")))
        .when(kind == "ISO_OFFSET", F.try_to_timestamp(t))
        .when(kind == "NAIVE_LOCAL", F.to_utc_timestamp(F.try_to_timestamp(t), zone))
    )


def convention_census(df: DataFrame, raw: str) -> DataFrame:
    """Rows of each convention, and whether these needed repair."""
    got = df.groupBy(timestamp_convention(F.col(raw)).alias("convention")).agg(F.count("*").alias("n"))
    return got.withColumn("affected", F.col("convention") != "ISO_OFFSET")


def absent_members(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Members of a dimension without any row."""
    return expected.select(key).distinct().join(present.select(key), key, "left_anti")


def grid_coverage(df: DataFrame, keys: Sequence[str], n_cells: Column) -> DataFrame:
    """Share of a grid's cells with a row, in percent at one decimal."""
    return df.select(*keys).distinct().agg(F.round(100 * F.count("*") / n_cells, 1).alias("coverage_pct"))


def freshness(age_hours: Column, cadence_hours: Column) -> Column:
    return F.when(age_hours <= 1.25 * cadence_hours, "CURRENT").when(age_hours <= 2 * cadence_hours, "LAGGING").otherwise("STALE")


def refresh_age_hours(raw: Column, as_of: Column, zone: str = IST) -> Column:
    """Hours from a refresh time (local where it has no offset) to ``as_of``."""
    return (F.unix_timestamp(as_of) - F.unix_timestamp(normalise_timestamp(raw, zone))) / 3600


def defect(df: DataFrame, defect_id: str, kind: str, severity: str, action: str, bad: Column) -> DataFrame:
    """One defect row: affected and total rows, and the rate at five decimals."""
    n = F.count_if(bad)
    return df.agg(n.alias("affected"), F.count("*").alias("total")).select(
        F.lit(defect_id).alias("defect_id"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(action).alias("action"),
        "affected", "total", F.round(F.coalesce(F.try_divide("affected", "total"), F.lit(0.0)), 5).alias("rate"),
    )


def worst_severity(defects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The worst severity (of each group), LOW where there is none."""
    order = F.array(*map(F.lit, SEVERITIES))
    top = F.max(F.array_position(order, F.col("severity")))
    return defects.groupBy(*by).agg(F.element_at(order, F.greatest(F.coalesce(top, F.lit(1)), F.lit(1)).cast("int")).alias("severity"))


def stale_sources(freshness_rows: DataFrame) -> DataFrame:
    return freshness_rows.where("status in ('STALE', 'MISSING')").select("source")


def blocking_gaps(gaps: DataFrame, kpi: str) -> DataFrame:
    """Gaps that block a KPI: one row for each blocked KPI of a gap, filtered."""
    return gaps.withColumn("kpi", F.explode("blocks")).where(F.col("kpi") == kpi).drop("blocks")
