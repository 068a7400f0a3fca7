"""Loaders, conformed tables and panels, fed with source-shaped rows made of the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.operators import conform, decompose, estimate, gates, movement, panel, quality
from kpiscope.plans import model as m
from kpiscope.plans.registry import registry
from kpiscope.sources import files, loaders

QUERIES, SQL = {}, {}
query = registry(QUERIES, SQL)

#: Line items as daily orders: a discount of zero counts as unknown, a negative number of units is
#: planted on some keys, later versions of a day, region and line come with a later ingest time.
_RAW = """raw AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS source_row_id, CAST(l_shipdate AS DATE) AS date, 'R' || (l_suppkey % 5) AS region, 'P' || (l_partkey % 6) AS product_line,
 CASE WHEN l_orderkey % 97 = 0 THEN -l_quantity ELSE l_quantity END AS units_shipped, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END AS units_returned, l_extendedprice AS gross_sales,
 CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount END AS discounts, CAST(l_shipdate AS DATE) + CAST(l_linenumber % 5 AS INTEGER) AS ingested, 1 AS shipped_orders FROM lineitem)"""
_ORDERS = _RAW + """, flagged AS (SELECT *, discounts IS NULL OR units_shipped < 0 AS quarantined FROM raw),
orders_ AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY date, region, product_line ORDER BY ingested DESC, source_row_id DESC) = 1)"""
_REFUNDS = """refunds_ AS (SELECT date, region, product_line, units_returned * 2 AS refunds FROM raw WHERE units_returned > 0 QUALIFY row_number() OVER (PARTITION BY date, region, product_line ORDER BY CAST(ingested AS VARCHAR) DESC, source_row_id DESC) = 1)"""


def raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    c, date = F.col, F.col("l_shipdate").cast("date")
    return m.t(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("source_row_id"), date.alias("date"),
        F.concat(F.lit("R"), (c("l_suppkey") % 5).cast("string")).alias("region"), F.concat(F.lit("P"), (c("l_partkey") % 6).cast("string")).alias("product_line"),
        F.when(c("l_orderkey") % 97 == 0, -c("l_quantity")).otherwise(c("l_quantity")).alias("units_shipped"), F.when(c("l_returnflag") == "R", c("l_quantity")).otherwise(0.0).alias("units_returned"),
        c("l_extendedprice").alias("gross_sales"), F.when(c("l_discount") > 0, c("l_extendedprice") * c("l_discount")).alias("discounts"),
        F.date_add(date, (c("l_linenumber") % 5).cast("int")).cast("timestamp").alias("ingested_at"), F.lit(1).alias("shipped_orders"),
    )


def raw_refunds(spark: SparkSession, sf: str) -> DataFrame:
    return raw_orders(spark, sf).where("units_returned > 0").select("source_row_id", "date", "region", "product_line", (F.col("units_returned") * 2).alias("refunds"), "ingested_at")


@query(f"WITH {_ORDERS} SELECT date, region, product_line, gross_sales, quarantined, CAST(ingested - date AS INTEGER) AS arrival_lag_days, ingested - date > 2 AS is_late FROM orders_", dates="date")
def orders_load(spark: SparkSession, sf: str) -> DataFrame:
    got = loaders.orders(raw_orders(spark, sf))
    return got.select("date", "region", "product_line", "gross_sales", F.col("_quarantined").alias("quarantined"), "arrival_lag_days", "is_late")


@query(f"""WITH {_RAW}, k AS (SELECT date, region, product_line FROM raw GROUP BY ALL HAVING count(*) > 1), c AS (SELECT 'ERP-001' AS defect_id, count(CASE WHEN discounts IS NULL THEN 1 END) AS affected, count(*) AS total FROM raw
UNION ALL SELECT 'ERP-002', count(CASE WHEN units_shipped < 0 THEN 1 END), count(*) FROM raw UNION ALL SELECT 'ERP-003', count(CASE WHEN k.date IS NOT NULL THEN 1 END), count(*) FROM raw LEFT JOIN k USING (date, region, product_line)
UNION ALL SELECT 'ERP-004', count(CASE WHEN ingested - date > 2 THEN 1 END), count(*) FROM raw) SELECT *, round(affected / total, 5) AS rate FROM c""")
def orders_defects(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.order_defects(raw_orders(spark, sf)).select("defect_id", "affected", "total", "rate")


@query(f"WITH {_RAW}, {_REFUNDS} SELECT * FROM refunds_", dates="date")
def refunds_load(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.refunds(raw_refunds(spark, sf)).select("date", "region", "product_line", "refunds")


@query(f"""WITH {_ORDERS}, {_REFUNDS}, f AS (SELECT o.date, region, product_line, coalesce(r.refunds, 0) AS refunds, CASE WHEN NOT quarantined THEN gross_sales - coalesce(r.refunds, 0) - discounts END AS net, CASE WHEN NOT quarantined THEN units_shipped - units_returned END AS units
 FROM orders_ o LEFT JOIN refunds_ r USING (date, region, product_line))
SELECT date, region, product_line, refunds, round(net, 4) AS net_revenue, units AS units_sold, round(net / nullif(units, 0), 6) AS avg_selling_price, CAST(isodow(date) - 1 AS INTEGER) AS weekday, isodow(date) >= 6 AS is_weekend,
 'FY' || lpad(CAST((CASE WHEN month(date) >= 4 THEN year(date) + 1 ELSE year(date) END) % 100 AS VARCHAR), 2, '0') || '-P' || lpad(CAST((month(date) + 8) % 12 + 1 AS VARCHAR), 2, '0') AS fiscal_period FROM f""", dates="date")
def fact_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with refunds and calendar attributes, one row a day, region and line."""
    got = conform.fact_daily(loaders.orders(raw_orders(spark, sf)), loaders.refunds(raw_refunds(spark, sf)))
    return got.select("date", "region", "product_line", "refunds", F.round("net_revenue", 4).alias("net_revenue"), "units_sold", F.round("avg_selling_price", 6).alias("avg_selling_price"), "weekday", "is_weekend", "fiscal_period")


_DISPATCH = """dsp AS (SELECT event_id, date_trunc('second', ts) AS moment, 'W' || (user_id % 7) AS warehouse, 'R' || (user_id % 7 % 3) AS region, 40.0 AS promised, CASE WHEN event_id % 19 <> 0 THEN value END AS actual, event_id % 3 AS k FROM events),
dl AS (SELECT *, CAST(moment + INTERVAL 330 MINUTE AS DATE) AS date FROM dsp)"""


def raw_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Events as dispatches, their times in three conventions and some durations unknown."""
    ev = m.t(spark, sf, "events").withColumn("at", F.date_trunc("second", "ts").cast("timestamp"))
    local = F.date_format(F.from_utc_timestamp("at", quality.IST), "yyyy-MM-dd'T'HH:mm:ss")
    k, w = F.col("event_id") % 3, F.col("user_id") % 7
    raw = F.when(k == 0, F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).when(k == 1, local).otherwise((F.unix_timestamp("at") * 1000).cast("string"))
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"), raw.alias("ts_raw"), F.concat(F.lit("W"), w.cast("string")).alias("warehouse"), F.concat(F.lit("R"), (w % 3).cast("string")).alias("region"),
        F.lit(40.0).alias("promised_hours"), F.when(F.col("event_id") % 19 != 0, F.col("value")).alias("actual_hours"),
    )


@query(f"""WITH {_DISPATCH} SELECT date, CASE k WHEN 0 THEN 'ISO_OFFSET' WHEN 1 THEN 'NAIVE_LOCAL' ELSE 'EPOCH_MS' END AS convention, count(*) AS n, count(CASE WHEN actual IS NULL THEN 1 END) AS n_quarantined, count(CASE WHEN actual <= promised THEN 1 END) AS n_in_time FROM dl GROUP BY ALL""", dates="date")
def dispatch_load(spark: SparkSession, sf: str) -> DataFrame:
    got = loaders.dispatch(raw_dispatch(spark, sf))
    return got.groupBy("date", "convention").agg(F.count("*").alias("n"), F.count_if("_quarantined").alias("n_quarantined"), F.count_if("sla_met").alias("n_in_time"))


_TICKETS = """tk AS (SELECT CAST(ts AS DATE) + CAST(CASE WHEN event_id % 23 = 0 THEN 3 ELSE 0 END AS INTEGER) AS date, 'R' || (user_id % 3) AS region, CAST(event_id % 4 AS INTEGER) AS complaint_tickets, CAST(event_id % 9 AS INTEGER) AS total_tickets, CAST(date_trunc('second', ts) + INTERVAL 330 MINUTE AS DATE) AS local_day FROM events),
tf AS (SELECT *, date > local_day OR date > DATE '2024-01-25' AS future FROM tk)"""
_END = dt.date(2024, 1, 25)


def raw_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ticket counts; some bear a later date than their ingest."""
    k = F.col("event_id")
    return m.t(spark, sf, "events").select(
        F.date_add(F.col("ts").cast("date"), F.when(k % 23 == 0, 3).otherwise(0)).alias("date"), F.concat(F.lit("R"), (F.col("user_id") % 3).cast("string")).alias("region"),
        (k % 4).cast("int").alias("complaint_tickets"), (k % 9).cast("int").alias("total_tickets"), F.date_trunc("second", "ts").cast("timestamp").alias("ingested_at"),
    )


@query(f"WITH {_TICKETS} SELECT date, region, future AS future_dated, count(*) AS n, CAST(sum(total_tickets) AS BIGINT) AS total_tickets FROM tf GROUP BY ALL", dates="date")
def tickets_load(spark: SparkSession, sf: str) -> DataFrame:
    got = loaders.tickets(raw_tickets(spark, sf), _END)
    return got.groupBy("date", "region", "future_dated").agg(F.count("*").alias("n"), F.sum("total_tickets").alias("total_tickets"))


@query(f"""WITH {_DISPATCH}, {_TICKETS}, w AS (SELECT date, warehouse, region, count(*) AS n, count(CASE WHEN actual <= promised THEN 1 END) AS k, avg(actual) AS h FROM dl WHERE actual IS NOT NULL GROUP BY ALL),
r AS (SELECT date, region, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(k) AS BIGINT) AS in_time, sum(h * n) / sum(n) AS weighted, avg(h) AS plain FROM w GROUP BY ALL), t AS (SELECT date, region, CAST(sum(complaint_tickets) AS BIGINT) AS complaints, CAST(sum(total_tickets) AS BIGINT) AS tickets FROM tf WHERE NOT future GROUP BY ALL),
o AS (SELECT CAST(ts AS DATE) AS date, 'R' || (event_id % 3) AS region, count(*) AS shipped FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT r.date, r.region, attempts, in_time, round(weighted, 6) AS mean_hours, round(plain, 6) AS plain_hours, round(in_time / attempts, 6) AS on_time, complaints, tickets, shipped, round(1000.0 * complaints / nullif(shipped, 0), 4) AS complaint_rate FROM r LEFT JOIN t USING (date, region) LEFT JOIN o USING (date, region)""", dates="date")
def region_ops_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Dispatch by region and day with tickets and orders; hours weighted by attempts and plain."""
    wh = conform.warehouse_daily(loaders.dispatch(raw_dispatch(spark, sf)))
    tickets = loaders.tickets(raw_tickets(spark, sf), _END)
    orders = m.events(spark, sf).where("event_type = 'purchase'").select("date", F.concat(F.lit("R"), (F.col("event_id") % 3).cast("string")).alias("region"), F.lit(1).alias("shipped_orders"))
    got = conform.region_daily(wh, tickets, orders)
    plain = conform.region_daily(wh, tickets, orders, weighted=False).select("date", "region", F.round("mean_hours", 6).alias("plain_hours"))
    return got.join(plain, ["date", "region"]).select(
        "date", "region", F.col("dispatch_attempts").alias("attempts"), F.col("dispatched_within_sla").alias("in_time"), F.round("mean_hours", 6).alias("mean_hours"), "plain_hours", F.round("on_time_dispatch_rate", 6).alias("on_time"),
        F.col("complaint_tickets").alias("complaints"), F.col("total_tickets").alias("tickets"), F.col("shipped_orders").alias("shipped"), F.round("complaint_rate", 4).alias("complaint_rate"),
    )


@query("""SELECT n_name AS region FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def marketing_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Expected regions without any row of the feed."""
    nations = m.t(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    feed = m.t(spark, sf, "customer").where("c_acctbal > 9900").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("region")
    return loaders.marketing_gaps(feed, nations)


@query("""SELECT CAST(date_trunc('week', CAST(ts AS DATE)) AS DATE) AS week_start, event_type AS channel, count(*) AS n FROM events GROUP BY ALL""", dates="week_start")
def marketing_load(spark: SparkSession, sf: str) -> DataFrame:
    raw = m.events(spark, sf).select(F.col("date").alias("week_start"), F.col("event_type").alias("channel"))
    return loaders.marketing(raw).groupBy("week_start", "channel").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS date, 'P' || (user_id % 6) AS product_line FROM events WHERE value > 98) SELECT round(100.0 * count(*) / (30 * 6), 1) AS coverage_pct FROM e""")
def external_coverage(spark: SparkSession, sf: str) -> DataFrame:
    raw = loaders.external(m.events(spark, sf).where("value > 98").select("date", F.concat(F.lit("P"), (F.col("user_id") % 6).cast("string")).alias("product_line")))
    return loaders.external_coverage(raw, dt.date(2024, 1, 1), dt.date(2024, 1, 30), [f"P{i}" for i in range(6)])


@query("""SELECT 'orders' AS source, max(CAST(o_orderdate AS DATE)) AS period_end FROM orders UNION ALL SELECT 'weekly', CAST(max(date_trunc('week', CAST(ts AS DATE))) AS DATE) + 6 FROM events""", dates="period_end")
def source_period_end(spark: SparkSession, sf: str) -> DataFrame:
    orders = loaders.period_end(m.t(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")), "date")
    weekly = loaders.period_end(m.events(spark, sf).select(F.date_trunc("week", "date").cast("date").alias("week_start")), "week_start", 6)
    return orders.select(F.lit("orders").alias("source"), "period_end").union(weekly.select(F.lit("weekly").alias("source"), "period_end"))


@query("""WITH l AS (SELECT event_type AS source, max(date_trunc('second', ts)) AS moment FROM events GROUP BY 1), a AS (SELECT source, date_diff('second', moment, TIMESTAMP '2024-01-31 00:00:00') / 3600.0 AS age FROM l)
SELECT source, round(age, 6) AS age_hours FROM a WHERE age > 2 * 0.02""")
def stale_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose newest row is older than twice their cadence; times are local and unzoned."""
    local = F.date_format(F.from_utc_timestamp(F.date_trunc("second", "ts").cast("timestamp"), quality.IST), "yyyy-MM-dd'T'HH:mm:ss")
    last = m.events(spark, sf).groupBy(F.col("event_type").alias("source")).agg(F.max(local).alias("raw"))
    age = quality.refresh_age_hours(F.col("raw"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    rows = last.select("source", age.alias("age"), quality.freshness(age, F.lit(0.02)).alias("status"))
    return rows.join(quality.stale_sources(rows), "source").select("source", F.round("age", 6).alias("age_hours"))


@query("""SELECT s_suppkey AS gap_id FROM supplier WHERE s_suppkey % 3 = 1 OR s_suppkey % 3 = 2 AND s_suppkey % 2 = 0""")
def blocking_gaps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    blocks = F.when(k % 3 == 1, F.array(F.lit("net_revenue"), F.lit("units_sold"))).when((k % 3 == 2) & (k % 2 == 0), F.array(F.lit("net_revenue"))).otherwise(F.array(F.lit("complaint_rate")))
    return quality.blocking_gaps(m.t(spark, sf, "supplier").select(k.alias("gap_id"), blocks.alias("blocks")), "net_revenue").select("gap_id")


@query(f"""WITH {m.SQL_LINES}, w AS (SELECT l_suppkey AS cell, date, gross_sales AS v, units_shipped AS q FROM lines), a AS (SELECT cell, CAST(sum(v) AS DOUBLE) AS v, CAST(sum(q) AS DOUBLE) AS q FROM w WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-01-07' GROUP BY 1),
b AS (SELECT cell, CAST(sum(v) AS DOUBLE) AS v, CAST(sum(q) AS DOUBLE) AS q FROM w WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-01-07' GROUP BY 1)
SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.v, 0) AS v0, coalesce(a.q, 0) AS q0, coalesce(b.v, 0) AS v1, coalesce(b.q, 0) AS q1 FROM a FULL JOIN b ON a.cell = b.cell""")
def window_cells_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Two windows computed apart: suppliers of one only count as zero in the other."""
    def window(y: int) -> DataFrame:
        inside = m.lines(spark, sf).where(F.col("date").between(F.lit(dt.date(y, 1, 1)), F.lit(dt.date(y, 1, 7))))
        return inside.groupBy(F.col("l_suppkey").alias("cell")).agg(F.sum("gross_sales").cast("double").alias("v"), F.sum("units_shipped").cast("double").alias("q"))

    return decompose.join_windows(window(1996), window(1997), ["cell"])


@query("""WITH o AS (SELECT CAST(ts AS DATE) AS date, CASE WHEN event_id % 3 = 0 THEN NULL WHEN value > 50 THEN 1 ELSE 0 END AS flag, user_id % 40 AS line FROM events) SELECT date, line, round(avg(flag), 6) AS flag FROM o GROUP BY ALL""", dates="date")
def observed_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of observed flags a day and line; unknown where none is observed."""
    flag = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("int")).when(F.col("value") > 50, 1).otherwise(0)
    rows = m.t(spark, sf, "events").select(F.col("ts").cast("date").alias("date"), (F.col("user_id") % 40).alias("line"), flag.alias("flag"))
    return panel.observed_mean(rows, "flag", ("date", "line")).withColumn("flag", F.round("flag", 6))


@query(f"""WITH {m.SQL_EVENTS}, s AS (SELECT CAST(d AS DATE) AS date FROM generate_series((SELECT min(date) FROM ev), (SELECT max(date) FROM ev), INTERVAL 1 DAY) g(d)), a AS (SELECT date, CAST(sum(value) AS DOUBLE) AS arr FROM ev WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT date, count(*) AS clicks FROM ev WHERE event_type = 'click' GROUP BY 1)
SELECT s.date, clicks, CASE WHEN s.date >= DATE '2024-01-11' THEN arr END AS arr FROM s LEFT JOIN a USING (date) LEFT JOIN c USING (date)""", dates="date")
def launch_panel(spark: SparkSession, sf: str) -> DataFrame:
    """A calendar panel with a measure that is unknown before its launch."""
    ev = m.events(spark, sf)
    ends = ev.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    sources = {
        "arr": ev.where("event_type = 'purchase'").groupBy("date").agg(F.sum("value").cast("double").alias("arr")),
        "clicks": ev.where("event_type = 'click'").groupBy("date").agg(F.count("*").alias("clicks")),
    }
    got = panel.unknown_before(panel.calendar_panel(spark, ends["a"], ends["b"], sources), "arr", dt.date(2024, 1, 11))
    return got.select("date", "clicks", "arr")


#: In the years of the line items the calendar has no holidays or promotions, so the calendar's
#: least squares are means by weekday, which SQL can express.
_DAILY = f"{m.SQL_LINES}, y AS (SELECT date, CAST(sum(gross_sales) AS DOUBLE) AS value, isodow(date) AS dow FROM lines GROUP BY date)"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return m.lines(spark, sf).groupBy("date").agg(F.sum("gross_sales").cast("double").alias("value"))


@query(f"""WITH {_DAILY}, w AS (SELECT dow, avg(value) AS mean FROM y GROUP BY 1), r AS (SELECT 1 - sum((value - mean) * (value - mean)) / (SELECT sum((value - a) * (value - a)) FROM y, (SELECT avg(value) AS a FROM y)) AS r2 FROM y JOIN w USING (dow))
SELECT date, value, round(value - mean + (SELECT mean FROM w WHERE dow = 1), 3) AS adjusted, round(r2, 6) AS r2 FROM y JOIN w USING (dow), r""", dates="date")
def calendar_adjusted_series(spark: SparkSession, sf: str) -> DataFrame:
    got, r2 = movement.calendar_adjust(_daily(spark, sf))
    return got.select("date", "value", F.round("adjusted", 3).alias("adjusted"), F.lit(round(r2, 6)).alias("r2"))


@query(f"""WITH {_DAILY}, f AS (SELECT *, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM y), w AS (SELECT dow, avg(value) AS mean FROM f WHERE i <= greatest(30, floor(0.6 * n)) GROUP BY 1)
SELECT date, round(mean / (SELECT mean FROM w WHERE dow = 1), 6) AS seasonality FROM y JOIN w USING (dow)""", dates="date")
def seasonal_index(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted weekday level over the Monday's, from the first 60 percent of the days."""
    return panel.seasonal_index(_daily(spark, sf), "value").select("date", F.round("seasonality", 6).alias("seasonality"))


@query(f"""WITH {_DAILY}, t AS (SELECT *, date_diff('day', (SELECT min(date) FROM y), date) AS t FROM y), d AS (SELECT *, value - avg(value) OVER (PARTITION BY dow) AS vv, t - avg(t) OVER (PARTITION BY dow) AS tt FROM t), b AS (SELECT sum(vv * tt) / sum(tt * tt) AS slope FROM d)
SELECT date, round(vv - slope * tt, 1) + 0.0 AS residual FROM d, b""", dates="date")
def prewhitened(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals on weekday and trend (the trend partialled out by weekday)."""
    return gates.prewhiten(_daily(spark, sf), "value", "residual").select("date", (F.round("residual", 1) + 0.0).alias("residual"))


@query(f"""WITH {_DAILY}, a AS (SELECT avg(CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN value END) AS b, avg(CASE WHEN date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN value END) AS f FROM y)
SELECT 'OK' AS status, round(b, 3) AS baseline, round(f, 3) AS focus, round(100 * (f / b - 1), 5) AS pct, CASE WHEN f > b THEN 'UP' WHEN f < b THEN 'DOWN' ELSE 'FLAT' END AS direction FROM a""")
def movement_detected(spark: SparkSession, sf: str) -> DataFrame:
    """The movement between two years; the permutation test's own p is random and left out."""
    got = movement.detect(_daily(spark, sf), m.BASE, m.FOCUS, permutations=50)
    return spark.createDataFrame([(got.status, round(got.baseline, 3), round(got.focus, 3), round(got.pct, 5), got.direction)], "status string, baseline double, focus double, pct double, direction string")


_PAIR = f"""{m.SQL_LINES}, p AS (SELECT date, CAST(sum(CASE WHEN l_returnflag = 'R' THEN gross_sales ELSE 0 END) AS DOUBLE) AS x, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN gross_sales ELSE 0 END) AS DOUBLE) AS y FROM lines GROUP BY date),
s AS (SELECT x, y, row_number() OVER (ORDER BY date) - 1 AS i FROM p)"""


@query(f"""WITH {_PAIR}, n AS (SELECT count(*) AS n, greatest(40, CAST(floor(0.7 * count(*)) AS BIGINT)) AS size FROM s), w AS (SELECT DISTINCT CAST(floor((n - size) * k / 23.0) AS BIGINT) AS a, size FROM n, range(0, 24) r(k) WHERE n >= size),
j AS (SELECT w.a, l.lag, u.x, v.y FROM w, (SELECT CAST(range AS BIGINT) - 14 AS lag FROM range(0, 29)) l JOIN s u ON true JOIN s v ON v.i = u.i + l.lag WHERE u.i >= w.a AND u.i < w.a + w.size AND v.i >= w.a AND v.i < w.a + w.size),
c AS (SELECT a, lag, corr(x, y) AS r FROM j GROUP BY a, lag HAVING count(*) >= 15), b AS (SELECT a, arg_max(lag, (round(abs(r), 9), -lag)) AS lag FROM c WHERE r IS NOT NULL GROUP BY a),
q AS (SELECT count(*) AS n, CAST(trunc(quantile_cont(lag, 0.05)) AS INTEGER) AS q05, CAST(trunc(quantile_cont(lag, 0.25)) AS INTEGER) AS q25, CAST(trunc(quantile_cont(lag, 0.75)) AS INTEGER) AS q75, CAST(trunc(quantile_cont(lag, 0.95)) AS INTEGER) AS q95 FROM b)
SELECT n, n >= 5 AND q75 - q25 <= 5 AND q25 >= 1 AS stable, CASE WHEN n >= 5 THEN q05 END AS q05, CASE WHEN n >= 5 THEN q25 END AS q25, CASE WHEN n >= 5 THEN q75 END AS q75, CASE WHEN n >= 5 THEN q95 END AS q95 FROM q""")
def lag_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Best lags of two daily series over 24 sliding windows of 70 percent, and their quartiles."""
    returned = F.col("l_returnflag") == "R"
    p = m.lines(spark, sf).groupBy("date").agg(F.sum(F.when(returned, F.col("gross_sales")).otherwise(0)).cast("double").alias("x"), F.sum(F.when(~returned, F.col("gross_sales")).otherwise(0)).cast("double").alias("y"))
    return gates.lag_stability_table(p, "x", "y")


@query("""WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey % 21) - 6 END AS lag, (o_orderkey % 20 - 10) / 12.5 AS r, o_orderkey % 2 = 0 AS stable, CASE WHEN o_orderkey % 5 = 0 THEN 7.0 ELSE 1.0 END AS res FROM orders)
SELECT CASE WHEN lag IS NULL THEN 'NOT_COMPUTABLE' WHEN abs(r) < 0.3 THEN 'ASSOCIATION_TOO_WEAK' WHEN lag <= 0 THEN 'NO_LEAD' WHEN lag < res THEN 'GRAIN_TOO_COARSE' WHEN NOT stable THEN 'UNSTABLE_LAG' ELSE 'PASS' END AS code,
 count(*) AS n, count(CASE WHEN lag IS NOT NULL AND NOT (lag BETWEEN -1 AND 9) THEN 1 END) AS n_review FROM h GROUP BY 1""")
def temporal_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    lag = F.when(k % 17 != 0, (k % 21) - 6)
    h = m.t(spark, sf, "orders").select(lag.alias("lag"), ((k % 20 - 10) / 12.5).alias("r"), (k % 2 == 0).alias("stable"), F.when(k % 5 == 0, 7.0).otherwise(1.0).alias("res"))
    code, review = gates.temporal_columns(F.col("lag"), F.col("r"), F.col("stable"), F.col("res"), (1, 7))
    return h.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.count_if(review).alias("n_review"))


_BALANCED = m.SQL_CELLS + f""", p AS (SELECT cell, product_line, month, units_sold AS y, region = '{m.TREATED}' AS treated, month >= DATE '{m.T0}' AS post FROM cells WHERE month BETWEEN DATE '{m.PANEL[0]}' AND DATE '{m.PANEL[1]}')"""


@query(f"""WITH {_BALANCED}, b AS (SELECT *, CASE WHEN treated THEN row_number() OVER (PARTITION BY cell ORDER BY month) - 1 ELSE 0 END AS x FROM p WHERE NOT post),
e AS (SELECT cell, y - avg(y) OVER (PARTITION BY cell) - avg(y) OVER (PARTITION BY product_line, month) + avg(y) OVER (PARTITION BY product_line) AS yy, x - avg(x) OVER (PARTITION BY cell) - avg(x) OVER (PARTITION BY product_line, month) + avg(x) OVER (PARTITION BY product_line) AS xx FROM b),
s AS (SELECT sum(yy * xx) / sum(xx * xx) AS slope, sum(xx * xx) AS sxx, count(*) AS n FROM e), c AS (SELECT cell, sum(xx * (yy - slope * xx)) AS u FROM e, s GROUP BY cell), g AS (SELECT sum(u * u) AS meat, count(*) AS g FROM c)
SELECT round(slope, 5) AS slope, round(sqrt(meat * g / (g - 1)) / sxx, 5) AS se, g, n FROM s, g""")
def pre_trend(spark: SparkSession, sf: str) -> DataFrame:
    """The treated cells' extra trend before the change; needs a panel without holes."""
    from kpiscope.plans.causal_queries import did_panel

    got = estimate.parallel_trends_balanced(did_panel(spark, sf), "y", group="product_line")
    return got.select(F.round("att", 5).alias("slope"), F.round("se", 5).alias("se"), "g", "n")


@query(f"""WITH {m.SQL_FACTS}, p AS (SELECT region, month, CAST(sum(units_sold) AS DOUBLE) AS y, month >= DATE '{m.T0}' AS post FROM facts WHERE month BETWEEN DATE '{m.PANEL[0]}' AND DATE '{m.PANEL[1]}' GROUP BY ALL), r AS (SELECT DISTINCT region AS chosen FROM p),
a AS (SELECT chosen, (avg(CASE WHEN region = chosen AND post THEN y END) - avg(CASE WHEN region = chosen AND NOT post THEN y END)) - (avg(CASE WHEN region <> chosen AND post THEN y END) - avg(CASE WHEN region <> chosen AND NOT post THEN y END)) AS att FROM p, r GROUP BY chosen)
SELECT round(x.att, 4) AS att, count(*) FILTER (abs(a.att) >= abs(x.att) - 1e-9) / count(*) AS ri_p, CAST(count(*) AS INTEGER) AS n_assignments, 'EXACT' AS mode FROM a, (SELECT att FROM a WHERE chosen = '{m.TREATED}') x GROUP BY x.att""")
def did_twfe_ri(spark: SparkSession, sf: str) -> DataFrame:
    """Region cells: one treated of five, all assignments enumerated."""
    from kpiscope.plans.causal_queries import did_panel

    p = did_panel(spark, sf).groupBy("region", "date", "treated", "post").agg(F.sum("y").alias("y")).withColumnRenamed("region", "cell")
    r = estimate.did(p, "y")
    return spark.createDataFrame([(round(float(r["estimate"]), 4), float(r["ri_p"]), int(r["ri_assignments"]), r["ri_mode"])], "att double, ri_p double, n_assignments int, mode string")


@query("""WITH f AS (SELECT o_totalprice AS y, o_custkey % 100 AS a, o_orderkey % 37 AS b FROM orders), d AS (SELECT y - avg(y) OVER () AS y, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, avg(y) OVER () AS my, avg(a) OVER () AS ma, avg(b) OVER () AS mb FROM f),
s AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb, sum(y * y) AS yy, any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb FROM d),
c AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s)
SELECT round(my - ca * ma - cb * mb, 2) AS const, round(ca, 4) AS a, round(cb, 4) AS b, round((ca * ay + cb * yb) / yy, 8) AS r2 FROM c""")
def ols_two_regressors(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares from cross-products summed in one aggregation."""
    df = m.t(spark, sf, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 100).cast("double").alias("a"), (F.col("o_orderkey") % 37).cast("double").alias("b"))
    beta, r2 = movement.solve(df, "y", {"const": F.lit(1.0), "a": F.col("a"), "b": F.col("b")})
    return spark.createDataFrame([(round(beta["const"], 2), round(beta["a"], 4), round(beta["b"], 4), round(r2, 8))], "const double, a double, b double, r2 double")


@query("""SELECT CAST(d AS DATE) AS date, CAST(isodow(d) - 1 AS INTEGER) AS weekday, CASE WHEN isodow(d) = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dow6, 1.0::DOUBLE AS const, date_diff('day', DATE '2000-01-01', CAST(d AS DATE))::DOUBLE AS trend FROM generate_series(DATE '2026-01-01', DATE '2026-12-31', INTERVAL 1 DAY) g(d)""", dates="date")
def calendar_design(spark: SparkSession, sf: str) -> DataFrame:
    """The regressors of the calendar adjustment, for each day of a year."""
    from kpiscope.functions.calendar import days

    x = movement.design_columns(trend=True)
    return days(spark, dt.date(2026, 1, 1), dt.date(2026, 12, 31)).select("date", F.weekday("date").alias("weekday"), x["dow6"].alias("dow6"), x["const"].alias("const"), x["trend"].alias("trend"))


@query(f"""WITH {_ORDERS} SELECT 'fact_daily' AS target, (SELECT count(*) FROM raw) AS rows_in, (SELECT count(*) FROM orders_) AS rows_out, 1.0::DOUBLE AS temporal_resolution_days""")
def transform_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """What a transform read and wrote, and the days within which its values are known."""
    raw = raw_orders(spark, sf)
    got = conform.lineage(spark, {"fact_daily": (raw, loaders.orders(raw))}).where("target = 'fact_daily'")
    return got.select("target", "rows_in", "rows_out", F.lit(conform.temporal_resolution("fact_daily")).alias("temporal_resolution_days"))


@query(f"WITH {m.SQL_LINES} SELECT CAST(date_trunc('month', date) AS DATE) AS month, l_returnflag AS flag, CAST(sum(gross_sales) AS DOUBLE) AS gross FROM lines WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY ALL", dates="month")
def month_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items written by month and read back; the filter prunes folders."""
    path = files.scratch_path(spark, "month-partitions")
    files.write_month_partitions(m.lines(spark, sf).select("date", F.col("l_returnflag").alias("flag"), "gross_sales"), path)
    got = spark.read.parquet(path).where("month between '1996-01' and '1998-12'")
    return got.groupBy(F.to_date(F.concat("month", F.lit("-01"))).alias("month"), "flag").agg(F.sum("gross_sales").cast("double").alias("gross"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as CSV and read back with their types."""
    path = files.scratch_path(spark, "csv")
    src = m.t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.write_csv(src, path)
    return spark.read.schema(src.schema).option("header", True).option("mode", "FAILFAST").csv(path)
