"""The analytics model over the driver's tables, as DataFrames and as DuckDB SQL.

region: customer's region; product_line: part type; date: ship date; gross_sales: extended price;
discounts: its discounted part; refunds: what returned lines had brought in. Money is decimal,
so sums are exact and both engines agree.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.operators.metrics import FLOW, RATIO, STOCK, Kpi

BASE = (dt.date(1996, 1, 1), dt.date(1996, 12, 31))
FOCUS = (dt.date(1997, 1, 1), dt.date(1997, 12, 31))
#: The months in which every region and line has rows from scale factor 0.01 on.
PANEL = (dt.date(1995, 2, 1), dt.date(2001, 6, 30))
T0 = dt.date(1998, 1, 1)
TREATED = "ASIA"

KPIS = {
    k.kpi_id: k
    for k in (
        Kpi("net_revenue", "gross_sales - refunds - discounts", FLOW, alert_pct=3.0, materiality_abs=4e6, materiality_pct=1.5, not_interchangeable_with=("gross_revenue", "recognized_revenue_finance")),
        Kpi("gross_revenue", "gross_sales", FLOW, alert_pct=5.0, materiality_abs=6e6, materiality_pct=2.0, not_interchangeable_with=("net_revenue", "recognized_revenue_finance")),
        Kpi("units_sold", "units_shipped - units_returned", FLOW, alert_pct=4.0, materiality_abs=4e6, materiality_pct=1.5),
        Kpi("avg_selling_price", "net_revenue / units_sold", RATIO, alert_pct=2.0, materiality_abs=2e6, materiality_pct=0.8),
        Kpi("on_time_dispatch_rate", "dispatched_within_sla / dispatch_attempts", RATIO, grain=("date", "warehouse"), alert_pct=5.0, alert_direction="down", materiality_abs=1.5e6, materiality_pct=0.5),
        Kpi("complaint_rate", "complaint_tickets / shipped_orders", RATIO, scale=1000.0, alert_pct=10.0, alert_direction="up", materiality_abs=1e6, materiality_pct=0.4),
        Kpi("subscription_arr", "12 * monthly_subscription_revenue", STOCK, grain=("date", "region"), alert_pct=15.0, materiality_abs=8e5, materiality_pct=0.3, multiplier=1),
    )
}


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with money as decimals; no join."""
    price, disc = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    returned = F.col("l_returnflag") == "R"
    zero = F.lit(0).cast("decimal(18,4)")
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_returnflag", F.col("l_shipdate").cast("date").alias("date"),
        price.alias("gross_sales"), (price * disc).cast("decimal(18,4)").alias("discounts"),
        F.when(returned, (price - price * disc).cast("decimal(18,4)")).otherwise(zero).alias("refunds"),
        F.col("l_quantity").cast("decimal(12,2)").alias("units_shipped"),
        F.when(returned, F.col("l_quantity")).otherwise(0.0).cast("decimal(12,2)").alias("units_returned"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with region and product line. Nation and region are small fixed dimensions;
    orders, customers and parts join by their keys."""
    geo = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    cust = t(spark, sf, "customer").select("c_custkey", "c_nationkey").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey").join(cust.select("c_custkey", "region"), F.col("o_custkey") == F.col("c_custkey"))
    parts = t(spark, sf, "part").select("p_partkey", F.col("p_type").alias("product_line"))
    got = lines(spark, sf).join(orders.select("o_orderkey", "region"), F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return got.select(
        "date", F.trunc("date", "month").alias("month"), "region", "product_line", "gross_sales", "discounts", "refunds", "units_shipped", "units_returned",
        (F.col("gross_sales") - F.col("refunds") - F.col("discounts")).cast("decimal(20,4)").alias("net_revenue"),
        (F.col("units_shipped") - F.col("units_returned")).cast("decimal(13,2)").alias("units_sold"),
    )


def month_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Region x line x month, as doubles."""
    got = facts(spark, sf).groupBy("month", "region", "product_line").agg(*[F.sum(m).cast("double").alias(m) for m in ("net_revenue", "units_sold", "gross_sales")])
    return got.withColumn("cell", F.concat_ws(" | ", "region", "product_line"))


def warehouse_lines(spark: SparkSession, sf: str) -> DataFrame:
    geo = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = t(spark, sf, "supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("region"))
    li = t(spark, sf, "lineitem").select("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), "l_linestatus", "l_quantity")
    return li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select("month", F.col("l_suppkey").alias("warehouse"), "region", (F.col("l_linestatus") == "F").alias("sla_met"), F.col("l_quantity").alias("hours"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("date"), F.col("ts"), "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), "props")


#: DuckDB's side of the same model.
SQL_LINES = """lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus, l_returnflag, CAST(l_shipdate AS DATE) AS date,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_sales,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discounts,
    CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) ELSE 0 END AS refunds,
    CAST(l_quantity AS DECIMAL(12,2)) AS units_shipped,
    CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(12,2)) ELSE 0 END AS units_returned
  FROM lineitem)"""
SQL_FACTS = SQL_LINES + """, facts AS (
  SELECT date, CAST(date_trunc('month', date) AS DATE) AS month, r_name AS region, p_type AS product_line, gross_sales, discounts, refunds, units_shipped, units_returned,
    gross_sales - refunds - discounts AS net_revenue, units_shipped - units_returned AS units_sold
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
SQL_CELLS = SQL_FACTS + """, cells AS (
  SELECT month, region, product_line, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue, CAST(sum(units_sold) AS DOUBLE) AS units_sold,
    CAST(sum(gross_sales) AS DOUBLE) AS gross_sales, region || ' | ' || product_line AS cell
  FROM facts GROUP BY month, region, product_line)"""
SQL_WH = """wh AS (
  SELECT CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS month, l_suppkey AS warehouse, r_name AS region, l_linestatus = 'F' AS sla_met, l_quantity AS hours
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_EVENTS = """ev AS (SELECT event_id, CAST(ts AS DATE) AS date, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value, props FROM events)"""
