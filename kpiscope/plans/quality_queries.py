"""Data-quality, freshness, conformance and panel queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.operators import conform, panel, quality
from kpiscope.plans import model as m
from kpiscope.plans.registry import registry

QUERIES, SQL = {}, {}
query = registry(QUERIES, SQL)

#: By this rule a line without discount counts as one whose discount is missing.
_KEY = ("l_orderkey", "l_linenumber")


@query(f"WITH {m.SQL_LINES} SELECT 'ERP-001' AS defect_id, count(CASE WHEN discounts = 0 THEN 1 END) AS affected, count(*) AS total, round(count(CASE WHEN discounts = 0 THEN 1 END) / count(*), 5) AS rate FROM lines")
def dq_missing(spark: SparkSession, sf: str) -> DataFrame:
    li = m.lines(spark, sf).withColumn("discounts", F.when(F.col("discounts") != 0, F.col("discounts")))
    return quality.defect(li, "ERP-001", "MISSING_VALUE", "MEDIUM", "QUARANTINE", quality.missing("discounts")).select("defect_id", "affected", "total", "rate")


@query("SELECT 'ERP-002' AS defect_id, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS affected, count(*) AS total, round(count(CASE WHEN c_acctbal < 0 THEN 1 END) / count(*), 5) AS rate FROM customer")
def dq_sign(spark: SparkSession, sf: str) -> DataFrame:
    return quality.defect(m.t(spark, sf, "customer"), "ERP-002", "SIGN_ERROR", "HIGH", "QUARANTINE", quality.negative("c_acctbal")).select("defect_id", "affected", "total", "rate")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT l_extendedprice) AS n_values, count(DISTINCT l_extendedprice) > 1 AS conflict FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicates(m.t(spark, sf, "lineitem"), _KEY, "l_extendedprice")


@query("""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1""", dates="date")
def dedupe_latest(spark: SparkSession, sf: str) -> DataFrame:
    got = quality.latest(m.t(spark, sf, "lineitem"), _KEY, [F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey")])
    return got.select(*_KEY, F.col("l_shipdate").cast("date").alias("date"), "l_partkey", "l_suppkey")


@query("""SELECT o_orderpriority, count(*) AS n, count(CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 2 THEN 1 END) AS n_late, max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS max_lag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def dq_late_arrival(spark: SparkSession, sf: str) -> DataFrame:
    both = m.t(spark, sf, "lineitem").join(m.t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    date, got = F.col("o_orderdate").cast("date"), F.col("l_shipdate")
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(quality.late(got, date)).alias("n_late"), F.max(quality.arrival_lag(got, date)).cast("long").alias("max_lag"))


@query("SELECT event_type, count(*) AS n, count(CASE WHEN CAST(ts AS DATE) > DATE '2024-01-25' THEN 1 END) AS n_future FROM events GROUP BY 1")
def dq_future_dated(spark: SparkSession, sf: str) -> DataFrame:
    ev = m.events(spark, sf)
    bad = quality.future_dated(F.col("date"), F.col("ts").cast("timestamp"), dt.date(2024, 1, 25))
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_future"))


@query("SELECT n_name AS member FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def coverage_gap_anti(spark: SparkSession, sf: str) -> DataFrame:
    have = m.t(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    gone = quality.absent_members(m.t(spark, sf, "nation"), have, "n_nationkey")
    return gone.join(m.t(spark, sf, "nation"), "n_nationkey").select(F.col("n_name").alias("member"))


@query("""WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS date, event_type FROM events WHERE event_type IN ('error', 'purchase') AND value > 90)
SELECT round(100.0 * count(*) / (30 * 2), 1) AS coverage_pct FROM e""")
def grid_coverage(spark: SparkSession, sf: str) -> DataFrame:
    ev = m.events(spark, sf).where("event_type in ('error', 'purchase') and value > 90")
    return quality.grid_coverage(ev, ("date", "event_type"), F.lit(30 * 2))


@query("""SELECT event_type AS source, max(ts) AS last_seen, CASE WHEN date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') / 3600.0 <= 1.25 * 0.5 THEN 'CURRENT'
 WHEN date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') / 3600.0 <= 1.0 THEN 'LAGGING' ELSE 'STALE' END AS status FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY 1""", dates="last_seen")
def freshness_status(spark: SparkSession, sf: str) -> DataFrame:
    last = m.events(spark, sf).groupBy(F.col("event_type").alias("source")).agg(F.max(F.date_trunc("second", "ts")).alias("last_seen"))
    age = (F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))) / 3600
    return last.select("source", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), quality.freshness(age, F.lit(0.5)).alias("status"))


@query("""SELECT CASE event_id % 5 WHEN 0 THEN 'ISO_OFFSET' WHEN 1 THEN 'NAIVE_LOCAL' WHEN 2 THEN 'EPOCH_MS' WHEN 3 THEN 'EMPTY' ELSE 'UNPARSEABLE' END AS convention,
 count(*) AS n, event_id % 5 <> 0 AS affected, count(CASE WHEN event_id % 5 < 3 THEN 1 END) AS n_same FROM events GROUP BY ALL""")
def ts_conventions(spark: SparkSession, sf: str) -> DataFrame:
    """Event times written in five ways; those that parse come back as the same instant."""
    ev = m.events(spark, sf).withColumn("at", F.date_trunc("second", F.col("ts")).cast("timestamp"))
    text = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")
    local = F.date_format(F.from_utc_timestamp("at", quality.IST), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(text, F.lit("+00:00"))).when(k == 1, local).when(k == 2, (F.unix_timestamp("at") * 1000).cast("string")).when(k == 3, "").otherwise("n/a")
    ev = ev.withColumn("raw", raw).withColumn("same", quality.normalise_timestamp(F.col("raw")) == F.col("at"))
    census = quality.convention_census(ev, "raw")
    same = ev.groupBy(quality.timestamp_convention(F.col("raw")).alias("convention")).agg(F.count_if("same").alias("n_same"))
    return census.join(same, "convention").select("convention", "n", "affected", "n_same")


@query(f"WITH {m.SQL_WH} SELECT month, warehouse, region, count(*) AS attempts, count(CASE WHEN sla_met THEN 1 END) AS within_sla, round(avg(hours), 6) AS mean_hours, round(quantile_cont(hours, 0.9), 6) AS p90_hours FROM wh GROUP BY month, warehouse, region", dates="month")
def dispatch_daily_p90(spark: SparkSession, sf: str) -> DataFrame:
    wh = m.warehouse_lines(spark, sf).select(F.col("month").alias("date"), "warehouse", "region", "sla_met", F.col("hours").alias("actual_hours"), F.lit(False).alias("_quarantined"))
    got = conform.warehouse_daily(wh)
    return got.select(F.col("date").alias("month"), "warehouse", "region", F.col("dispatch_attempts").alias("attempts"), F.col("dispatched_within_sla").alias("within_sla"), F.round("mean_hours", 6).alias("mean_hours"), F.round("p90_hours", 6).alias("p90_hours"))


@query(f"""WITH {m.SQL_WH}, d AS (SELECT month, warehouse, region, count(*) AS n, count(CASE WHEN sla_met THEN 1 END) AS k, avg(hours) AS h FROM wh GROUP BY month, warehouse, region)
SELECT month, region, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(k) AS BIGINT) AS within_sla, round(avg(h), 5) AS plain_hours, round(sum(h * n) / sum(n), 5) AS weighted_hours, round(sum(k) / sum(n), 6) AS rate FROM d GROUP BY month, region""", dates="month")
def region_rollup(spark: SparkSession, sf: str) -> DataFrame:
    wh = m.warehouse_lines(spark, sf).groupBy("month", "warehouse", "region").agg(F.count("*").alias("n"), F.count_if("sla_met").alias("k"), F.avg("hours").alias("h"))
    return wh.groupBy("month", "region").agg(
        F.sum("n").alias("attempts"), F.sum("k").alias("within_sla"), F.round(F.avg("h"), 5).alias("plain_hours"),
        F.round(F.sum(F.col("h") * F.col("n")) / F.sum("n"), 5).alias("weighted_hours"), F.round(F.sum("k") / F.sum("n"), 6).alias("rate"),
    )


@query(f"""WITH {m.SQL_EVENTS}, w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, event_type, sum(value) AS value FROM ev GROUP BY 1, 2),
a AS (SELECT week_start + CAST(i AS INTEGER) AS date, event_type, CAST(value AS DOUBLE) / 7 AS value, week_start FROM w, generate_series(0, 6) g(i))
SELECT CAST(date AS DATE) AS date, event_type, round(value, 6) AS value, true AS is_imputed, week_start AS source_week_start FROM a WHERE date <= DATE '2024-01-30'""", dates="date source_week_start")
def weekly_allocation(spark: SparkSession, sf: str) -> DataFrame:
    weekly = m.events(spark, sf).groupBy(F.date_trunc("week", "date").cast("date").alias("week_start"), "event_type").agg(F.sum("value").cast("double").alias("value"))
    got = conform.allocate_weeks(weekly, "value", dt.date(2024, 1, 30), keys=("event_type",))
    return got.select("date", "event_type", F.round("value", 6).alias("value"), "is_imputed", "source_week_start")


@query("""WITH g AS (SELECT CAST(d AS DATE) AS date, p_type AS product_line FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) s(d), (SELECT DISTINCT p_type FROM part)),
o AS (SELECT CAST(ts AS DATE) AS date, 'PROMO' AS product_line, max(CASE WHEN value > 95 THEN 1 ELSE 0 END) AS promo_active FROM events WHERE event_type = 'signup' AND value > 60 GROUP BY 1)
SELECT g.date, g.product_line, o.promo_active, o.promo_active IS NOT NULL AS observed FROM g LEFT JOIN o USING (date, product_line)""", dates="date")
def densified_external(spark: SparkSession, sf: str) -> DataFrame:
    seen = m.events(spark, sf).where("event_type = 'signup' and value > 60").groupBy("date").agg(F.max((F.col("value") > 95).cast("int")).alias("promo_active"))
    seen = seen.withColumn("product_line", F.lit("PROMO"))
    lines = m.t(spark, sf, "part").select(F.col("p_type").alias("product_line"))
    return conform.densify(seen, lines, dt.date(2024, 1, 1), dt.date(2024, 1, 30)).select("date", "product_line", "promo_active", "observed")


@query(f"""WITH {m.SQL_EVENTS}, e AS (SELECT date, count(*) AS complaints FROM ev WHERE event_type = 'error' GROUP BY 1), p AS (SELECT date, count(*) AS orders FROM ev WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.date, complaints, orders, round(1000.0 * complaints / nullif(orders, 0), 4) AS complaint_rate FROM e LEFT JOIN p USING (date)""", dates="date")
def cross_source_complaint_rate(spark: SparkSession, sf: str) -> DataFrame:
    from kpiscope.functions.scalars import safe_ratio

    ev = m.events(spark, sf)
    e = ev.where("event_type = 'error'").groupBy("date").agg(F.count("*").alias("complaints"))
    p = ev.where("event_type = 'purchase'").groupBy("date").agg(F.count("*").alias("orders"))
    return e.join(p, "date", "left").withColumn("complaint_rate", F.round(safe_ratio(F.col("complaints"), F.col("orders"), 1000.0), 4))


_WINDOWS = "(VALUES ('W1', DATE '1996-03-01', DATE '1996-03-31'), ('W2', DATE '1996-03-20', DATE '1996-04-20'), ('W3', DATE '1997-11-01', DATE '1997-11-30')) w(promo, a, b)"


@query(f"""WITH {m.SQL_LINES}, d AS (SELECT date, sum(gross_sales) AS gross FROM lines GROUP BY date), j AS (SELECT d.date, gross, min(promo) AS promo FROM d LEFT JOIN {_WINDOWS} ON d.date BETWEEN a AND b GROUP BY 1, 2)
SELECT coalesce(promo, 'NONE') AS promo, count(*) AS n_days, CAST(sum(gross) AS DOUBLE) AS gross FROM j GROUP BY 1""")
def promo_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """The first of the overlapping windows that holds a day: a range join on a 3-row table."""
    rows = [("W1", dt.date(1996, 3, 1), dt.date(1996, 3, 31)), ("W2", dt.date(1996, 3, 20), dt.date(1996, 4, 20)), ("W3", dt.date(1997, 11, 1), dt.date(1997, 11, 30))]
    w = spark.createDataFrame(rows, "promo string, a date, b date")
    d = m.lines(spark, sf).groupBy("date").agg(F.sum("gross_sales").alias("gross"))
    j = d.join(F.broadcast(w), F.col("date").between(F.col("a"), F.col("b")), "left").groupBy("date", "gross").agg(F.min("promo").alias("promo"))
    return j.groupBy(F.coalesce("promo", F.lit("NONE")).alias("promo")).agg(F.count("*").alias("n_days"), F.sum("gross").cast("double").alias("gross"))


@query(f"""WITH {m.SQL_EVENTS}, s AS (SELECT CAST(d AS DATE) AS date FROM generate_series((SELECT min(date) FROM ev), (SELECT max(date) FROM ev) + 10, INTERVAL 1 DAY) g(d)),
a AS (SELECT date, count(*) AS n_all FROM ev GROUP BY 1), h AS (SELECT date, count(*) AS n_high FROM ev WHERE value > 99.8 GROUP BY 1), p AS (SELECT s.date, n_all, n_high, CAST(NULL AS BIGINT) AS n_none FROM s LEFT JOIN a USING (date) LEFT JOIN h USING (date)),
c AS (SELECT count(*) AS n, count(n_all) AS a, count(n_high) AS h, count(n_none) AS z FROM p), l AS (SELECT 'n_all' AS variable, a AS n_known, n FROM c UNION ALL SELECT 'n_high', h, n FROM c UNION ALL SELECT 'n_none', z, n FROM c)
SELECT variable, n_known, n, round(100.0 * n_known / n, 2) AS pct, CASE WHEN 100.0 * n_known / n > 99 THEN 'COMPLETE' WHEN 100.0 * n_known / n >= 50 THEN 'PARTIAL' WHEN n_known > 0 THEN 'SPARSE' ELSE 'ABSENT' END AS status FROM l""")
def panel_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from kpiscope.functions.calendar import days

    ev = m.events(spark, sf)
    sources = {
        "all": ev.groupBy("date").agg(F.count("*").alias("n_all")),
        "high": ev.where("value > 99.8").groupBy("date").agg(F.count("*").alias("n_high")),
    }
    ends = ev.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    p = panel.daily_panel(days(spark, ends["a"], ends["b"] + dt.timedelta(days=10)), sources).withColumn("n_none", F.lit(None).cast("long"))
    return panel.coverage(p, ["n_all", "n_high", "n_none"])


@query(f"WITH {m.SQL_CELLS} SELECT month, cell, net_revenue, units_sold FROM cells", dates="month")
def unit_panel(spark: SparkSession, sf: str) -> DataFrame:
    got = panel.unit_panel(m.facts(spark, sf), ("region", "product_line"), ("net_revenue", "units_sold"), date="month")
    return got.select("month", "cell", F.col("net_revenue").cast("double").alias("net_revenue"), F.col("units_sold").cast("double").alias("units_sold"))


@query("SELECT 'lineitem' AS \"table\", count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def row_count_summary(spark: SparkSession, sf: str) -> DataFrame:
    from kpiscope.sources.files import row_counts

    return row_counts({n: m.t(spark, sf, n) for n in ("lineitem", "orders", "part")})


@query(f"WITH {m.SQL_LINES} SELECT date, CAST(sum(gross_sales) AS DOUBLE) AS value FROM lines GROUP BY date", dates="date")
def point_series(spark: SparkSession, sf: str) -> DataFrame:
    from kpiscope.operators.metrics import points

    series = m.lines(spark, sf).select("date", F.col("gross_sales").alias("value"))
    return points(series).select("date", F.col("value").cast("double").alias("value"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date, CAST(v.price AS DOUBLE) AS price FROM lineitem JOIN (VALUES ('v1', DATE '1995-01-01', 1.00), ('v2', DATE '1997-01-01', 1.03), ('v3', DATE '1999-07-01', 1.08)) v(name, a, price)
ON v.a = (SELECT max(x) FROM (VALUES (DATE '1995-01-01'), (DATE '1997-01-01'), (DATE '1999-07-01')) u(x) WHERE x <= CAST(l_shipdate AS DATE))""", dates="date")
def price_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The price version in force at a date: versions become half-open ranges by ``lead``, and
    join by range (three rows)."""
    from pyspark.sql import Window

    v = spark.createDataFrame([("v1", dt.date(1995, 1, 1), 1.00), ("v2", dt.date(1997, 1, 1), 1.03), ("v3", dt.date(1999, 7, 1), 1.08)], "name string, a date, price double")
    v = v.withColumn("b", F.lead("a").over(Window.orderBy("a")))
    li = m.t(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"))
    got = li.join(F.broadcast(v), (F.col("date") >= F.col("a")) & (F.col("b").isNull() | (F.col("date") < F.col("b"))))
    return got.select("l_partkey", "l_orderkey", "l_linenumber", "date", "price")
