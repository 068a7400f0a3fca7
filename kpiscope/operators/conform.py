"""Conformed tables at declared grains, each with a record of how it came about."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.functions.calendar import days, stamp
from kpiscope.functions.scalars import safe_ratio


@dataclass(frozen=True)
class Transform:
    transform_id: str
    source: str
    target: str
    method: str
    temporal_resolution_days: float


#: How each conformed table is made, and the days within which its values are known.
TRANSFORMS = (
    Transform("TR-ERP-01", "erp_orders_daily + erp_refunds_daily", "fact_daily", "left join, unknown refunds are zero, quarantined measures unknown", 1.0),
    Transform("TR-OPS-01", "ops_dispatch_events", "ops_wh_daily", "events to warehouse days", 1.0),
    Transform("TR-OPS-02", "ops_wh_daily + ops_support_tickets_daily", "ops_region_daily", "warehouse days to region days", 1.0),
    Transform("TR-MKT-01", "mkt_campaign_weekly", "mkt_region_daily", "a seventh of the week to each day", 7.0),
    Transform("TR-EXT-01", "ext_competitor_promo", "ext_line_daily", "grid of days and lines, unobserved cells unknown", 1.0),
)


def temporal_resolution(table: str) -> float:
    return next((t.temporal_resolution_days for t in TRANSFORMS if t.target == table), 1.0)


def lineage(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """The transforms, with the rows read and written of those whose (input, output) are given."""
    rows = []
    for t in TRANSFORMS:
        pair = (tables or {}).get(t.target)
        rows.append((t.transform_id, t.source, t.target, t.method, t.temporal_resolution_days, *([df.count() for df in pair] if pair else (None, None))))
    return spark.createDataFrame(rows, "transform_id string, source string, target string, method string, temporal_resolution_days double, rows_in long, rows_out long")


def fact_daily(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Orders with refunds (none recorded: zero), derived measures, calendar attributes."""
    key = ["date", "region", "product_line"]
    got = orders.join(refunds.select(*key, "refunds"), key, "left").withColumn("refunds", F.coalesce("refunds", F.lit(0.0)))
    sound = ~F.col("_quarantined")
    got = got.withColumns({
        "net_revenue": F.when(sound, F.col("gross_sales") - F.col("refunds") - F.col("discounts")),
        "units_sold": F.when(sound, F.col("units_shipped") - F.col("units_returned")),
    })
    return stamp(got.withColumn("avg_selling_price", safe_ratio(F.col("net_revenue"), F.col("units_sold"))))


def warehouse_daily(dispatch: DataFrame) -> DataFrame:
    sound = dispatch.where(~F.col("_quarantined"))
    got = sound.groupBy("date", "warehouse", "region").agg(
        F.count("*").alias("dispatch_attempts"), F.count_if("sla_met").alias("dispatched_within_sla"),
        F.avg("actual_hours").alias("mean_hours"), F.percentile("actual_hours", 0.9).alias("p90_hours"),
    )
    return got.withColumn("on_time_dispatch_rate", safe_ratio(F.col("dispatched_within_sla"), F.col("dispatch_attempts")))


def region_daily(warehouse: DataFrame, tickets: DataFrame, orders: DataFrame, weighted: bool = True) -> DataFrame:
    """Region days. Hours are weighted by attempts; ``weighted=False`` is the plain mean of
    warehouse means."""
    hours = F.try_divide(F.sum(F.col("mean_hours") * F.col("dispatch_attempts")), F.sum("dispatch_attempts")) if weighted else F.avg("mean_hours")
    got = warehouse.groupBy("date", "region").agg(
        F.sum("dispatch_attempts").alias("dispatch_attempts"), F.sum("dispatched_within_sla").alias("dispatched_within_sla"), hours.alias("mean_hours"),
    )
    got = got.withColumn("on_time_dispatch_rate", safe_ratio(F.col("dispatched_within_sla"), F.col("dispatch_attempts")))
    t = tickets.where(~F.col("future_dated")).groupBy("date", "region").agg(F.sum("complaint_tickets").alias("complaint_tickets"), F.sum("total_tickets").alias("total_tickets"))
    o = orders.groupBy("date", "region").agg(F.sum("shipped_orders").alias("shipped_orders"))
    got = got.join(t, ["date", "region"], "left").join(o, ["date", "region"], "left")
    return got.withColumn("complaint_rate", safe_ratio(F.col("complaint_tickets"), F.col("shipped_orders"), 1000.0))


def allocate_weeks(weekly: DataFrame, measure: str, end: dt.date | None = None, week: str = "week_start", keys: Sequence[str] = ("region",)) -> DataFrame:
    """A seventh of a week's value on each of its days, marked as imputed, up to ``end``."""
    sums = weekly.groupBy(week, *keys).agg(F.sum(measure).alias(measure))
    got = sums.withColumn("date", F.explode(F.sequence(F.col(week), F.date_add(week, 6))))
    if end is not None:
        got = got.where(F.col("date") <= F.lit(end))
    return got.select("date", *keys, (F.col(measure) / 7).alias(measure), F.lit("UNIFORM_SEVENTH").alias("allocation_method"), F.lit(True).alias("is_imputed"), F.col(week).alias("source_week_start"))


def densify(external: DataFrame, members: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The whole grid of days and members; cells without a row stay unknown, not zero."""
    grid = days(external.sparkSession, start, end).join(F.broadcast(members.select("product_line").distinct()), how="cross")
    got = grid.join(external.select("date", "product_line", "promo_active"), ["date", "product_line"], "left")
    return got.withColumn("observed", F.col("promo_active").isNotNull())
