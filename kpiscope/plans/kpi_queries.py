"""Calendar, KPI, grain and decomposition queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.functions import calendar as cal
from kpiscope.functions import scalars
from kpiscope.operators import decompose, metrics
from kpiscope.plans import model as m
from kpiscope.plans.registry import registry

QUERIES, SQL = {}, {}


query = registry(QUERIES, SQL)
_B, _F = (f"DATE '{a}' AND DATE '{b}'" for a, b in (m.BASE, m.FOCUS))
_HOL = ", ".join(f"DATE '{d}'" for d in cal.HOLIDAYS)
_PROMO = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{p.start}' AND DATE '{p.end}' THEN '{p.name}'" for p in cal.PROMOS) + " END"
_FY = "'FY' || lpad(CAST((year(date - INTERVAL 3 MONTH) + 1) % 100 AS VARCHAR), 2, '0')"
_FM = "(month(date) + 8) % 12 + 1"


@query(f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '2026-01-01', DATE '2026-12-31', INTERVAL 1 DAY)) AS DATE) AS date), c AS (SELECT *, {_PROMO} AS promo_id FROM d)
SELECT date, 'FY' || lpad(CAST((CASE WHEN month(date) >= 4 THEN year(date) + 1 ELSE year(date) END) % 100 AS VARCHAR), 2, '0') AS fiscal_year,
 'FY' || lpad(CAST((CASE WHEN month(date) >= 4 THEN year(date) + 1 ELSE year(date) END) % 100 AS VARCHAR), 2, '0') || '-Q' || CAST(CAST(ceil(({_FM}) / 3.0) AS INTEGER) AS VARCHAR) AS fiscal_quarter,
 'FY' || lpad(CAST((CASE WHEN month(date) >= 4 THEN year(date) + 1 ELSE year(date) END) % 100 AS VARCHAR), 2, '0') || '-P' || lpad(CAST({_FM} AS VARCHAR), 2, '0') AS fiscal_period,
 CAST(date_trunc('week', date) AS DATE) AS iso_week_start, CAST(date - CAST(isodow(date) % 7 AS INTEGER) AS DATE) AS fiscal_week_start,
 CAST(isodow(date) - 1 AS INTEGER) AS weekday, isodow(date) >= 6 AS is_weekend, date IN ({_HOL}) AS is_holiday, promo_id,
 promo_id IS NULL OR promo_id <> 'PROMO_FREEDOM' AS baseline_eligible,
 array_to_string(list_filter([CASE WHEN date_trunc('week', date) <> date - CAST(isodow(date) % 7 AS INTEGER) THEN 'WEEK_START_MISMATCH' END,
  CASE WHEN date IN ({_HOL}) AND promo_id IS NULL THEN 'HOLIDAY_WITHOUT_PROMO' END, CASE WHEN promo_id = 'PROMO_FREEDOM' THEN 'BASELINE_BLACKOUT' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM c""", dates="date iso_week_start fiscal_week_start")
def calendar_dim(spark: SparkSession, sf: str) -> DataFrame:
    got = cal.dim_calendar(spark, dt.date(2026, 1, 1), dt.date(2026, 12, 31))
    return got.select("date", "fiscal_year", "fiscal_quarter", "fiscal_period", "iso_week_start", "fiscal_week_start", "weekday", "is_weekend", "is_holiday", "promo_id", "baseline_eligible", F.array_join("conflicts", ",").alias("conflicts"))


@query(f"""WITH {m.SQL_FACTS}, p AS (SELECT *, 'FY' || lpad(CAST((CASE WHEN month(date) >= 4 THEN year(date) + 1 ELSE year(date) END) % 100 AS VARCHAR), 2, '0') || '-P' || lpad(CAST({_FM} AS VARCHAR), 2, '0') AS fiscal_period FROM facts),
e AS (SELECT fiscal_period, max(date) AS date FROM p GROUP BY 1)
SELECT fiscal_period, region, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue, e.date FROM p JOIN e USING (fiscal_period) GROUP BY fiscal_period, region, e.date""", dates="date")
def fiscal_period_rollup(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.fiscal_rollup(m.facts(spark, sf), metrics.Kpi("r", "net_revenue"))
    return got.select("fiscal_period", "region", F.col("net_revenue").cast("double").alias("net_revenue"), "date")


@query(f"WITH {m.SQL_FACTS} SELECT month, region, product_line, CAST(sum(gross_sales) - sum(refunds) - sum(discounts) AS DOUBLE) AS net_revenue FROM facts GROUP BY ALL", dates="month")
def net_revenue_by_grain(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.kpi_series(m.facts(spark, sf), m.KPIS["net_revenue"], ("region", "product_line"), date="month")
    return got.select("month", "region", "product_line", F.col("value").cast("double").alias("net_revenue"))


@query(f"WITH {m.SQL_FACTS} SELECT region, CAST(sum(gross_sales) AS DOUBLE) AS gross, CAST(sum(net_revenue) AS DOUBLE) AS net, round(100 * CAST(sum(net_revenue) AS DOUBLE) / CAST(sum(gross_sales) AS DOUBLE), 4) AS net_pct FROM facts GROUP BY region")
def gross_vs_net(spark: SparkSession, sf: str) -> DataFrame:
    got = m.facts(spark, sf).groupBy("region").agg(F.sum("gross_sales").cast("double").alias("gross"), F.sum("net_revenue").cast("double").alias("net"))
    return got.withColumn("net_pct", F.round(100 * scalars.safe_ratio(F.col("net"), F.col("gross")), 4))


@query(f"WITH {m.SQL_FACTS} SELECT month, region, round(CAST(sum(net_revenue) AS DOUBLE) / nullif(CAST(sum(units_sold) AS DOUBLE), 0), 4) AS asp FROM facts GROUP BY month, region", dates="month")
def asp_ratio(spark: SparkSession, sf: str) -> DataFrame:
    f = m.facts(spark, sf).withColumns({"net_revenue": F.col("net_revenue").cast("decimal(20,4)")})
    got = f.groupBy("month", "region").agg(F.sum("net_revenue").cast("double").alias("net_revenue"), F.sum("units_sold").cast("double").alias("units_sold"))
    return got.select("month", "region", F.round(scalars.safe_ratio(F.col("net_revenue"), F.col("units_sold")), 4).alias("asp"))


@query(f"""WITH {m.SQL_LINES}, d AS (SELECT date, sum(gross_sales) - sum(refunds) - sum(discounts) AS v FROM lines GROUP BY date)
SELECT CAST(sum(CASE WHEN date BETWEEN {_B} THEN v END) AS DOUBLE) AS base_total, CAST(sum(CASE WHEN date BETWEEN {_F} THEN v END) AS DOUBLE) AS focus_total,
 round(CAST(sum(CASE WHEN date BETWEEN {_B} THEN v END) AS DOUBLE) / count(CASE WHEN date BETWEEN {_B} THEN 1 END), 4) AS base_daily,
 round(CAST(sum(CASE WHEN date BETWEEN {_F} THEN v END) AS DOUBLE) / count(CASE WHEN date BETWEEN {_F} THEN 1 END), 4) AS focus_daily FROM d""")
def kpi_window_flow(spark: SparkSession, sf: str) -> DataFrame:
    kpi = m.KPIS["net_revenue"]
    series = metrics.kpi_series(m.lines(spark, sf), kpi)
    out = None
    for name, window in (("base", m.BASE), ("focus", m.FOCUS)):
        total = metrics.window_value(series, kpi, *window).select(F.col("value").cast("double").alias(f"{name}_total"))
        mean = metrics.daily_mean(series, *window).select(F.round(F.col("value").cast("double"), 4).alias(f"{name}_daily"))
        both = total.join(F.broadcast(mean), how="cross")  # one row each
        out = both if out is None else out.join(F.broadcast(both), how="cross")
    return out


@query(f"""WITH {m.SQL_EVENTS}, d AS (SELECT date, sum(value) AS v FROM ev WHERE event_type = 'purchase' GROUP BY date), r AS (SELECT date, sum(v) OVER (ORDER BY date) AS level FROM d)
SELECT CAST(arg_max(level, date) AS DOUBLE) AS value, max(date) AS date FROM r WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""", dates="date")
def kpi_window_stock(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    d = m.events(spark, sf).where("event_type = 'purchase'").groupBy("date").agg(F.sum("value").alias("v"))
    level = d.select("date", F.sum("v").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("value"))
    inside = level.where(F.col("date").between(F.lit(dt.date(2024, 1, 10)), F.lit(dt.date(2024, 1, 20))))
    got = metrics.window_value(inside, m.KPIS["subscription_arr"], dt.date(2024, 1, 10), dt.date(2024, 1, 20))
    return got.select(F.col("value").cast("double").alias("value")).join(inside.agg(F.max("date").alias("date")), how="cross")


@query(f"WITH {m.SQL_LINES} SELECT round(CAST(sum(gross_sales) - sum(refunds) - sum(discounts) AS DOUBLE) / CAST(sum(units_shipped) - sum(units_returned) AS DOUBLE), 6) AS value FROM lines WHERE date BETWEEN {_F}")
def kpi_window_ratio(spark: SparkSession, sf: str) -> DataFrame:
    li = m.lines(spark, sf).withColumns({"net_revenue": (F.col("gross_sales") - F.col("refunds") - F.col("discounts")).cast("decimal(20,4)"), "units_sold": (F.col("units_shipped") - F.col("units_returned")).cast("decimal(13,2)")})
    kpi = m.KPIS["avg_selling_price"]
    series = metrics.kpi_series(li, kpi).select("date", *[F.col(c).cast("double").alias(c) for c in kpi.columns])
    return metrics.window_value(series, kpi, *m.FOCUS).select(F.round("value", 6).alias("value"))


@query(f"WITH {m.SQL_FACTS} SELECT month, region, CAST(sum(net_revenue) AS DOUBLE) AS value FROM facts WHERE region IN ('ASIA') GROUP BY month, region", dates="month")
def row_scope_filtered_kpi(spark: SparkSession, sf: str) -> DataFrame:
    from kpiscope.plans.policy import Decision, scoped

    decision = Decision(True, "OK", regions=("ASIA",), dims=("region",), denied=("discounts",))
    got = scoped(m.facts(spark, sf), decision).groupBy("month", "region").agg(F.sum("net_revenue").cast("double").alias("value"))
    return got


@query(f"WITH {m.SQL_FACTS} SELECT month, region, product_line, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue, CAST(grouping_id(month, region, product_line) AS BIGINT) AS grain_id FROM facts GROUP BY ROLLUP (month, region, product_line)", dates="month")
def grain_lattice(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.grain_lattice(m.facts(spark, sf), ["net_revenue"], ["month", "region", "product_line"])
    return got.select("month", "region", "product_line", F.col("net_revenue").cast("double").alias("net_revenue"), "grain_id")


_CELLS = f"""WITH {m.SQL_FACTS}, days AS (SELECT count(DISTINCT CASE WHEN date BETWEEN {_B} THEN date END) AS d0, count(DISTINCT CASE WHEN date BETWEEN {_F} THEN date END) AS d1 FROM facts),
s AS (SELECT region, product_line, coalesce(CAST(sum(CASE WHEN date BETWEEN {_B} THEN net_revenue END) AS DOUBLE), 0) AS v0, coalesce(CAST(sum(CASE WHEN date BETWEEN {_B} THEN units_sold END) AS DOUBLE), 0) AS q0,
 coalesce(CAST(sum(CASE WHEN date BETWEEN {_F} THEN net_revenue END) AS DOUBLE), 0) AS v1, coalesce(CAST(sum(CASE WHEN date BETWEEN {_F} THEN units_sold END) AS DOUBLE), 0) AS q1
 FROM facts WHERE date BETWEEN {_B} OR date BETWEEN {_F} GROUP BY region, product_line),
c AS (SELECT region, product_line, v0 / greatest(d0, 1) AS v0, q0 / greatest(d0, 1) AS q0, v1 / greatest(d1, 1) AS v1, q1 / greatest(d1, 1) AS q1 FROM s, days)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("date")
    return decompose.cell_averages(m.facts(spark, sf), ["region", "product_line"], F.col("net_revenue"), F.col("units_sold"), d.between(*map(F.lit, m.BASE)), d.between(*map(F.lit, m.FOCUS)))


@query(_CELLS + """, k AS (SELECT sum(v0) AS cv0, sum(q0) AS cq0, sum(q1) AS cq1, sum(q1 * v0 / q0) AS old, sum(v1) AS cv1 FROM c WHERE q0 > 0 AND q1 > 0),
b AS (SELECT sum(v0) AS base, sum(v1) - sum(v0) AS total, coalesce(sum(CASE WHEN q0 <= 0 AND q1 > 0 THEN v1 END), 0) AS entry, -coalesce(sum(CASE WHEN q1 <= 0 AND q0 > 0 THEN v0 END), 0) AS exit FROM c)
SELECT round(base, 2) AS base, round(total, 2) AS total, round((cq1 - cq0) * cv0 / cq0, 2) AS volume, round(old - cq1 * cv0 / cq0, 2) AS mix, round(cv1 - old, 2) AS price, round(entry, 2) AS entry, round(exit, 2) + 0.0 AS exit,
 round(100 * (cq1 - cq0) * cv0 / cq0 / base, 4) AS volume_pp, true AS closes FROM k, b""")
def pvm_terms(spark: SparkSession, sf: str) -> DataFrame:
    got = decompose.closure_gap(decompose.pvm_terms(_cells(spark, sf)))
    return got.select(*[F.round(c, 2).alias(c) for c in ("base", "total", "volume", "mix", "price", "entry", "exit")], F.round("volume_pp", 4).alias("volume_pp"), "closes")


@query(_CELLS + """, k AS (SELECT *, sum(q0) OVER () AS qq0, sum(q1) OVER () AS qq1 FROM c WHERE q0 > 0 AND q1 > 0),
r AS (SELECT region, product_line, v1 - v0 AS contribution, 100 * (q1 - q0) / q0 AS volume_pct, qq1 * v0 / q0 * (q1 / qq1 - q0 / qq0) AS mix, q1 * (v1 / q1 - v0 / q0) AS price,
 CAST(row_number() OVER (ORDER BY abs(v1 - v0) DESC, region, product_line) AS INTEGER) AS rank FROM k)
SELECT region, product_line, round(contribution, 3) AS contribution, round(volume_pct, 3) AS volume_pct, round(mix, 3) AS mix, round(price, 3) AS price, rank FROM r WHERE rank <= 8""")
def pvm_cells(spark: SparkSession, sf: str) -> DataFrame:
    got = decompose.pvm_cells(_cells(spark, sf), ["region", "product_line"], top=8)
    return got.select("region", "product_line", *[F.round(c, 3).alias(c) for c in ("contribution", "volume_pct", "mix", "price")], "rank")


_ENTRY = _CELLS.replace("region, product_line", "part").replace(m.SQL_FACTS, m.SQL_LINES + ", facts AS (SELECT date, l_partkey AS part, gross_sales AS net_revenue, units_shipped AS units_sold FROM lines)")


@query(_ENTRY + """ SELECT count(CASE WHEN q0 <= 0 AND q1 > 0 THEN 1 END) AS n_entry, count(CASE WHEN q1 <= 0 AND q0 > 0 THEN 1 END) AS n_exit,
 round(coalesce(sum(CASE WHEN q0 <= 0 AND q1 > 0 THEN v1 END), 0), 3) AS entry, round(-coalesce(sum(CASE WHEN q1 <= 0 AND q0 > 0 THEN v0 END), 0), 3) AS exit FROM c""")
def pvm_entry_exit(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("date")
    src = m.lines(spark, sf).withColumnRenamed("l_partkey", "part")
    cells = decompose.cell_averages(src, ["part"], F.col("gross_sales"), F.col("units_shipped"), d.between(*map(F.lit, m.BASE)), d.between(*map(F.lit, m.FOCUS)))
    new, gone = (F.col("q0") <= 0) & (F.col("q1") > 0), (F.col("q1") <= 0) & (F.col("q0") > 0)
    return decompose.pvm_terms(cells).select(F.round("entry", 3).alias("entry"), F.round("exit", 3).alias("exit")).join(cells.agg(F.count_if(new).alias("n_entry"), F.count_if(gone).alias("n_exit")), how="cross")


@query(f"""WITH {m.SQL_FACTS}, d AS (SELECT region, date, sum(net_revenue) AS v FROM facts GROUP BY region, date), w AS (SELECT region, CAST(sum(CASE WHEN date BETWEEN {_B} THEN v END) AS DOUBLE) / count(CASE WHEN date BETWEEN {_B} THEN 1 END) AS base,
 CAST(sum(CASE WHEN date BETWEEN {_F} THEN v END) AS DOUBLE) / count(CASE WHEN date BETWEEN {_F} THEN 1 END) AS focus FROM d GROUP BY region)
SELECT region, round(base, 4) AS base, round(focus, 4) AS focus, round(100 * (focus / base - 1), 4) AS pct, abs(100 * (focus / base - 1)) >= 3 AS alert FROM w""")
def baseline_vs_focus(spark: SparkSession, sf: str) -> DataFrame:
    d = m.facts(spark, sf).groupBy("region", "date").agg(F.sum("net_revenue").alias("v"))
    b, f = (F.col("date").between(*map(F.lit, w)) for w in (m.BASE, m.FOCUS))

    def mean(w):
        return F.sum(F.when(w, F.col("v"))).cast("double") / F.count_if(w)

    w = d.groupBy("region").agg(mean(b).alias("base"), mean(f).alias("focus"))
    pct = 100 * (F.col("focus") / F.col("base") - 1)
    return w.select("region", F.round("base", 4).alias("base"), F.round("focus", 4).alias("focus"), F.round(pct, 4).alias("pct"), scalars.crosses(pct, 3.0, "both").alias("alert"))


@query(f"""WITH {m.SQL_FACTS}, l AS (SELECT product_line, sum(v) / count(*) AS per_day, min(date) AS first_date, max(date) AS last_date, arg_min(v, date) AS first_value, arg_max(v, date) AS last_value FROM (SELECT product_line, date, CAST(sum(net_revenue) AS DOUBLE) AS v FROM facts WHERE date BETWEEN {_F} GROUP BY 1, 2) GROUP BY product_line)
SELECT a.product_line AS new_line, b.product_line AS mature_line, round(a.per_day / b.per_day, 6) AS ratio, a.first_date, a.last_date, round(b.first_value, 4) AS mature_first, round(b.last_value, 4) AS mature_last FROM l a JOIN l b ON a.product_line = 'PROMO' OR a.product_line <> b.product_line
WHERE a.product_line = (SELECT min(product_line) FROM l) AND a.product_line <> b.product_line""", dates="first_date last_date")
def cohort_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """A line's revenue a day against every other line over the same dates."""
    f = m.facts(spark, sf).where(F.col("date").between(*map(F.lit, m.FOCUS)))
    days = f.groupBy("product_line", "date").agg(F.sum("net_revenue").cast("double").alias("v"))
    by = days.groupBy("product_line").agg((F.sum("v") / F.count("*")).alias("per_day"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("v", "date").alias("first_value"), F.max_by("v", "date").alias("last_value"))
    new = by.orderBy("product_line").limit(1).select(F.col("product_line").alias("new_line"), F.col("per_day").alias("new_day"), "first_date", "last_date")
    return by.drop("first_date", "last_date").join(F.broadcast(new), F.col("product_line") != F.col("new_line")).select("new_line", F.col("product_line").alias("mature_line"), F.round(F.col("new_day") / F.col("per_day"), 6).alias("ratio"), "first_date", "last_date", F.round("first_value", 4).alias("mature_first"), F.round("last_value", 4).alias("mature_last"))


@query("""WITH p AS (SELECT c_custkey, c_acctbal * c_custkey AS v, c_mktsegment || ' moved -' || CAST(c_custkey AS VARCHAR) || '.5 to ' || format('{:,}', c_custkey * 1000) || ' units by ' || c_name AS t FROM customer),
x AS (SELECT *, list_transform(regexp_extract_all(t, '[-+]?[0-9][0-9,]*([.][0-9]+)?', 0), lambda n: CAST(replace(n, ',', '') AS DOUBLE)) AS ns FROM p)
SELECT c_custkey, CASE WHEN abs(v) >= 1e7 THEN printf('%.2f', v / 1e7) || ' crore' WHEN abs(v) >= 1e5 THEN printf('%.2f', v / 1e5) || ' lakh' ELSE format('{:,}', CAST(round_even(v, 0) AS BIGINT)) END AS shown,
 substr(sha256(c_custkey || '|kpi'), 1, 8) AS id, CAST(len(ns) AS INTEGER) AS n_numbers, list_sum(ns) AS sum_numbers, greatest(1, CAST(floor(length(t) / 4.0) AS INTEGER)) AS tokens,
 contains(lower(t), 'building moved') AS has_phrase, date_diff('day', DATE '1995-01-01' + CAST(c_custkey % 2500 AS INTEGER), DATE '2001-08-01') AS history_days,
 date_diff('day', DATE '1995-01-01' + CAST(c_custkey % 2500 AS INTEGER), DATE '2001-08-01') < 60 AS newly FROM x""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Money, ids, numbers in text, token estimates, phrases and history, for every customer."""
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.concat(F.col("c_mktsegment"), F.lit(" moved -"), k.cast("string"), F.lit(".5 to "), F.format_number(k * 1000, 0), F.lit(" units by "), name)
    launch, as_of = F.date_add(F.lit(dt.date(1995, 1, 1)), (k % 2500).cast("int")), F.lit(dt.date(2001, 8, 1))
    numbers = scalars.numbers_in(F.col("t"))
    return m.t(spark, sf, "customer").withColumn("t", text).select(
        "c_custkey", scalars.money(F.col("c_acctbal") * k).alias("shown"), scalars.hash_id(8, k.cast("string"), F.lit("kpi")).alias("id"), F.size(numbers).alias("n_numbers"),
        F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x).alias("sum_numbers"), scalars.token_estimate(F.col("t")).alias("tokens"), scalars.has_phrase(F.col("t"), "building Moved").alias("has_phrase"),
        scalars.history_days(as_of, launch).cast("long").alias("history_days"), scalars.newly_launched(as_of, launch).alias("newly"),
    )


@query("SELECT c_custkey, c_nationkey, c_mktsegment, 'c_acctbal,c_name' AS denied FROM customer")
def column_redaction(spark: SparkSession, sf: str) -> DataFrame:
    got, gone = scalars.drop_denied(m.t(spark, sf, "customer"), ("c_name", "c_acctbal", "not_there"))
    return got.withColumn("denied", F.lit(",".join(sorted(gone))))


@query(f"""WITH {m.SQL_CELLS}, p AS (SELECT cell, units_sold AS y, region = '{m.TREATED}' AS treated, month >= DATE '{m.T0}' AS post FROM cells WHERE month BETWEEN DATE '{m.PANEL[0]}' AND DATE '{m.PANEL[1]}'),
a AS (SELECT (avg(CASE WHEN treated AND post THEN y END) - avg(CASE WHEN treated AND NOT post THEN y END)) - (avg(CASE WHEN NOT treated AND post THEN y END) - avg(CASE WHEN NOT treated AND NOT post THEN y END)) AS att, count(DISTINCT CASE WHEN treated THEN cell END) AS n_cells FROM p),
s AS (SELECT CAST(sum(net_revenue) AS DOUBLE) / count(DISTINCT date) AS per_day, CAST(sum(net_revenue) AS DOUBLE) / CAST(sum(units_sold) AS DOUBLE) AS price FROM facts WHERE region = '{m.TREATED}' AND date BETWEEN {_B}),
f AS (SELECT CAST(sum(net_revenue) AS DOUBLE) / count(DISTINCT date) AS focus_day FROM facts WHERE region = '{m.TREATED}' AND date BETWEEN {_F})
SELECT round(per_day, 3) AS per_day, round(price, 4) AS price, n_cells, round(att * n_cells * price, 1) AS did_exposure, round(focus_day - per_day, 3) AS delta_exposure FROM a, s, f""")
def segment_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """The treated region's revenue a day and price before, and what is at stake by two rules."""
    from kpiscope.operators.estimate import did_2x2
    from kpiscope.plans.causal_queries import did_panel

    f, seg = m.facts(spark, sf), F.col("region") == m.TREATED
    panel = did_panel(spark, sf)
    effect = did_2x2(panel, "y").first()["att"]
    cells = panel.where("treated").select("cell").distinct().count()
    before, after = (metrics.segment_revenue_per_day(f, seg, *w).first()["per_day"] for w in (m.BASE, m.FOCUS))
    price = metrics.baseline_price(f, seg, *m.BASE).first()["price"]
    row = (round(before, 3), round(price, 4), cells, round(metrics.exposure("DID", effect=effect, cells=cells, price=price), 1), round(metrics.exposure("DELTA", before=before, after=after), 3))
    return spark.createDataFrame([row], "per_day double, price double, n_cells long, did_exposure double, delta_exposure double")
