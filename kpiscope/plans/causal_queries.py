"""Movement, gate and estimator queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiscope.operators import estimate, gates, movement, structure
from kpiscope.operators.graph import Dag
from kpiscope.plans import model as m
from kpiscope.plans.registry import registry

QUERIES, SQL = {}, {}
query = registry(QUERIES, SQL)

_SERIES = f"{m.SQL_LINES}, s AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, CAST(sum(gross_sales) AS DOUBLE) AS value FROM lines GROUP BY 1)"
_DAYS = f"{m.SQL_EVENTS}, d AS (SELECT date, CAST(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS DOUBLE) AS x, CAST(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS DOUBLE) AS y, CAST(count(CASE WHEN event_type = 'click' THEN 1 END) AS DOUBLE) AS z FROM ev GROUP BY date)"


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return m.lines(spark, sf).groupBy(F.trunc("date", "month").alias("date")).agg(F.sum("gross_sales").cast("double").alias("value"))


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    def total(kind: str):
        return F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0)).cast("double")

    return m.events(spark, sf).groupBy("date").agg(total("purchase").alias("x"), total("view").alias("y"), F.count_if(F.col("event_type") == "click").cast("double").alias("z"))


@query(f"""WITH {_SERIES}, w AS (SELECT date, value, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n, sum(value) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
 sum(value * value) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS aa, sum(value) OVER () AS t, sum(value * value) OVER () AS tt FROM s),
q AS (SELECT *, abs((t - a) / (n - i) - a / i) / sqrt(greatest((aa - a * a / i) / (i - 1), 0) / i + greatest((tt - aa - (t - a) * (t - a) / (n - i)) / (n - i - 1), 0) / (n - i)) AS stat FROM w WHERE i >= 10 AND i <= n - 11)
SELECT n, CAST(arg_max(i, stat) AS BIGINT) AS split, arg_max(date, stat) AS split_at, round(max(stat), 4) AS stat FROM q GROUP BY n""", dates="split_at")
def changepoint_binseg(spark: SparkSession, sf: str) -> DataFrame:
    return movement.best_split(monthly(spark, sf)).select("n", "split", "split_at", F.round("stat", 4).alias("stat"))


@query(f"""WITH {_DAYS}, l AS (SELECT i AS lag FROM generate_series(-7, 7) g(i)), p AS (SELECT lag, a.x, b.y FROM l, d a JOIN d b ON b.date = a.date + CAST(lag AS INTEGER))
SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round(corr(x, y), 6) AS r FROM p GROUP BY lag""")
def lag_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = event_days(spark, sf)
    got = gates.lag_profile(d.select("date", F.col("x").alias("value")), d.select("date", F.col("y").alias("value")), most=7)
    return got.select("lag", "n", F.round("r", 6).alias("r"))


@query(f"""WITH {_SERIES}, w AS (SELECT value, lag(value) OVER (ORDER BY date) AS p FROM s), a AS (SELECT count(*) AS n, corr(value, p) AS rho, stddev_samp(value) AS sd FROM w)
SELECT n, round(rho, 6) AS rho, round(n * (1 - rho) / (1 + rho), 4) AS n_eff, round(2.8 * sd / sqrt(n * (1 - rho) / (1 + rho)), 2) AS mde FROM a""")
def autocorr_power(spark: SparkSession, sf: str) -> DataFrame:
    return gates.power(monthly(spark, sf)).select("n", F.round("rho", 6).alias("rho"), F.round("n_eff", 4).alias("n_eff"), F.round("mde", 2).alias("mde"))


@query(f"WITH {_SERIES}, u AS (SELECT date, value - avg(value) OVER () AS u FROM s), w AS (SELECT u, u - lag(u) OVER (ORDER BY date) AS d FROM u) SELECT round(sum(d * d) / sum(u * u), 6) AS dw FROM w")
def durbin_watson(spark: SparkSession, sf: str) -> DataFrame:
    u = monthly(spark, sf).withColumn("u", F.col("value") - F.avg("value").over(Window.partitionBy()))
    return estimate.durbin_watson(u).select(F.round("dw", 6).alias("dw"))


_LB = " + ".join(f"pow(sum(c * c{k}) / sum(c * c), 2) / (count(*) - {k})" for k in range(1, 11))
_LAGS = ", ".join(f"lag(c, {k}) OVER (ORDER BY date) AS c{k}" for k in range(1, 11))


@query(f"WITH {_SERIES}, u AS (SELECT date, value - avg(value) OVER () AS c FROM s), w AS (SELECT c, {_LAGS} FROM u) SELECT count(*) AS n, round(count(*) * (count(*) + 2) * ({_LB}), 5) AS q FROM w")
def ljung_box(spark: SparkSession, sf: str) -> DataFrame:
    return estimate.ljung_box(monthly(spark, sf), u="value").select("n", F.round("q", 5).alias("q"))


@query("""WITH p AS (SELECT s_suppkey AS hypothesis, s_nationkey AS family, CASE WHEN s_suppkey % 11 <> 0 THEN abs(s_acctbal) / 100000.0 END AS p FROM supplier),
k AS (SELECT * FROM p WHERE p IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, hypothesis) AS rank, count(*) OVER (PARTITION BY family) AS m FROM k),
a AS (SELECT *, min(least(p * m / rank, 1.0)) OVER (PARTITION BY family ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj FROM r)
SELECT hypothesis, family, p, rank, m, round(adj, 6) AS adjusted, adj <= 0.05 AS rejected FROM a""")
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    """A p-value for each supplier, adjusted within its nation; some are unknown."""
    k = F.col("s_suppkey")
    p = m.t(spark, sf, "supplier").select(k.alias("hypothesis"), F.col("s_nationkey").alias("family"), F.when(k % 11 != 0, F.abs("s_acctbal") / 100000.0).alias("p"))
    got = gates.benjamini_hochberg(p, family=("family",))
    return got.select("hypothesis", "family", "p", F.col("rank").cast("long").alias("rank"), "m", "adjusted", "rejected")


_DID = m.SQL_CELLS + f""", p AS (SELECT cell, product_line, month, units_sold AS y, region = '{m.TREATED}' AS treated, month >= DATE '{m.T0}' AS post FROM cells WHERE month BETWEEN DATE '{m.PANEL[0]}' AND DATE '{m.PANEL[1]}')"""


def did_panel(spark: SparkSession, sf: str) -> DataFrame:
    got = m.month_cells(spark, sf).where(F.col("month").between(*map(F.lit, m.PANEL)))
    return got.select("cell", "product_line", "region", F.col("month").alias("date"), F.col("units_sold").alias("y"), (F.col("region") == m.TREATED).alias("treated"), (F.col("month") >= F.lit(m.T0)).alias("post"))


@query(f"""WITH {_DID}, a AS (SELECT avg(CASE WHEN treated AND post THEN y END) AS t1, avg(CASE WHEN treated AND NOT post THEN y END) AS t0, avg(CASE WHEN NOT treated AND post THEN y END) AS c1, avg(CASE WHEN NOT treated AND NOT post THEN y END) AS c0, count(*) AS n FROM p)
SELECT round(t1, 4) AS t1, round(t0, 4) AS t0, round(c1, 4) AS c1, round(c0, 4) AS c0, n, round((t1 - t0) - (c1 - c0), 4) AS att FROM a""")
def did_2x2(spark: SparkSession, sf: str) -> DataFrame:
    return estimate.did_2x2(did_panel(spark, sf), "y").select(*[F.round(c, 4).alias(c) for c in ("t1", "t0", "c1", "c0", "att")], "n")


@query(f"""WITH {_DID}, x AS (SELECT *, CAST(treated AND post AS INTEGER) AS d FROM p),
e AS (SELECT cell, y - avg(y) OVER (PARTITION BY cell) - avg(y) OVER (PARTITION BY product_line, month) + avg(y) OVER (PARTITION BY product_line) AS yy, d - avg(d) OVER (PARTITION BY cell) - avg(d) OVER (PARTITION BY product_line, month) + avg(d) OVER (PARTITION BY product_line) AS dd FROM x),
b AS (SELECT sum(yy * dd) / sum(dd * dd) AS att, sum(dd * dd) AS xx, count(*) AS n FROM e), c AS (SELECT cell, sum(dd * (yy - att * dd)) AS s FROM e, b GROUP BY cell), g AS (SELECT sum(s * s) AS meat, count(*) AS g FROM c)
SELECT round(att, 5) AS att, round(sqrt(meat * g / (g - 1)) / xx, 5) AS se, g, n FROM b, g""")
def did_twfe_balanced(spark: SparkSession, sf: str) -> DataFrame:
    got = estimate.did_balanced(did_panel(spark, sf), "y", group="product_line")
    return got.select(F.round("att", 5).alias("att"), F.round("se", 5).alias("se"), "g", "n")


@query(f"""WITH {_DAYS}, c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM d) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM c""")
def partial_correlation(spark: SparkSession, sf: str) -> DataFrame:
    c = event_days(spark, sf).agg(F.corr("x", "y").alias("xy"), F.corr("x", "z").alias("xz"), F.corr("y", "z").alias("yz"))
    return c.select(F.round(structure.partial_corr_one(F.col("xy"), F.col("xz"), F.col("yz")), 6).alias("r"))


@query(f"""WITH {_SERIES}, p AS (SELECT date, value AS outcome, CASE WHEN month(date) <> 2 THEN value END AS driver, date >= DATE '1999-01-01' AS post FROM s)
SELECT count(CASE WHEN driver IS NOT NULL AND NOT post THEN 1 END) AS n_pre, count(CASE WHEN driver IS NOT NULL AND post THEN 1 END) AS n_post, round(count(driver) / count(*), 6) AS observed_share, '' AS failed, true AS passed FROM p""")
def data_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    p = monthly(spark, sf).select(F.col("value").alias("outcome"), F.when(F.month("date") != 2, F.col("value")).alias("driver"), (F.col("date") >= F.lit(dt.date(1999, 1, 1))).alias("is_post"))
    got = gates.sufficiency(p, "outcome", "driver")
    return got.select("n_pre", "n_post", F.round("observed_share", 6).alias("observed_share"), F.array_join("failed", ",").alias("failed"), "passed")


@query(f"WITH {_SERIES} SELECT date, round(sin(2 * pi() * date_diff('day', DATE '1995-01-01', date) / 7), 6) + 0.0 AS s1, round(cos(4 * pi() * date_diff('day', DATE '1995-01-01', date) / 7), 6) + 0.0 AS c2 FROM s", dates="date")
def fourier_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.datediff("date", F.lit(dt.date(1995, 1, 1)))
    s1, _, _, c2 = estimate.fourier(t)
    return monthly(spark, sf).select("date", (F.round(s1, 6) + 0.0).alias("s1"), (F.round(c2, 6) + 0.0).alias("c2"))


#: Blocks of about a week's length in the order of a hash, prefix sums of each permutation, its best split.
_PERMUTED = f"""WITH {m.SQL_CELLS}, s AS (SELECT product_line, month AS day, sum(units_sold) AS v FROM cells GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY product_line ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY product_line) AS n FROM s), z AS (SELECT *, greatest(2, n // 7) AS nb FROM r),
b AS (SELECT product_line, v, i, n, CASE WHEN i < (n % nb) * (n // nb + 1) THEN i // (n // nb + 1) ELSE (n % nb) + (i - (n % nb) * (n // nb + 1)) // (n // nb) END AS b FROM z),
k AS (SELECT product_line, b, min(i) AS first, count(*) AS size, unnest(generate_series(0, 399)) AS k FROM b GROUP BY product_line, b),
o AS (SELECT product_line, b, k, coalesce(sum(size) OVER (PARTITION BY product_line, k ORDER BY md5('7|' || k || '|' || b), b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first AS move FROM k),
y AS (SELECT product_line, -1 AS k, i AS place, n, v FROM b UNION ALL SELECT b.product_line, k, i + move, n, v FROM b JOIN o ON o.product_line = b.product_line AND o.b = b.b),
w AS (SELECT product_line, k, place AS i, n, sum(v) OVER (PARTITION BY product_line, k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, sum(v * v) OVER (PARTITION BY product_line, k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS aa,
 sum(v) OVER (PARTITION BY product_line, k) AS t, sum(v * v) OVER (PARTITION BY product_line, k) AS tt FROM y),
q AS (SELECT product_line, k, i, abs((t - a) / (n - i) - a / i) / sqrt(greatest((aa - a * a / i) / (i - 1), 0) / i + greatest((tt - aa - (t - a) * (t - a) / (n - i)) / (n - i - 1), 0) / (n - i)) AS stat FROM w WHERE i >= 10 AND i <= n - 11),
t AS (SELECT product_line, k, max(stat) AS stat, arg_max(i, stat) AS split FROM q GROUP BY product_line, k), u AS (SELECT * FROM t WHERE k = -1)
SELECT u.product_line, CAST(any_value(u.split) AS BIGINT) AS split, round(any_value(u.stat), 4) AS stat, count(CASE WHEN t.stat >= u.stat * (1 - 1e-9) THEN 1 END) AS hits, count(*) AS n, round((count(CASE WHEN t.stat >= u.stat * (1 - 1e-9) THEN 1 END) + 1) / (count(*) + 1.0), 6) AS p
FROM t JOIN u ON u.product_line = t.product_line WHERE t.k >= 0 GROUP BY u.product_line"""


@query(_PERMUTED)
def block_permutation_p(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each line's monthly units shifted, by 400 permutations of blocks."""
    s = m.facts(spark, sf).groupBy("product_line", "month").agg(F.sum("units_sold").cast("double").alias("value"))
    got = movement.permutation_test(s, order="month", by=["product_line"], n=400)
    return got.select("product_line", "split", F.round("stat", 4).alias("stat"), "hits", "n", F.round("p", 6).alias("p"))


#: Partial correlations given a trend and up to one more column, by the recursion from plain ones;
#: p is the share of Student's density outside t, summed over 2000 steps of its angle.
_SCREEN = f"""WITH {_DAYS}, s AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM d), k AS (SELECT w FROM generate_series(-1, 11) g(w)),
f AS (SELECT DISTINCT w, n, CASE WHEN w < 0 THEN n ELSE greatest(30, CAST(floor(0.7::DOUBLE * n) AS BIGINT)) END AS size FROM s, k),
b AS (SELECT w, size, CASE WHEN w < 0 THEN 0 WHEN w = 11 THEN greatest(0, n - size) ELSE CAST(floor(w * (greatest(0, n - size) / 11::DOUBLE)) AS BIGINT) END AS a FROM f),
c AS (SELECT w, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, corr(x, i) AS xt, corr(y, i) AS yt, corr(z, i) AS zt FROM s JOIN b ON i >= a AND i < a + size GROUP BY w),
o AS (SELECT *, (xy - xt * yt) / sqrt((1 - xt * xt) * (1 - yt * yt)) AS p_xy, (xz - xt * zt) / sqrt((1 - xt * xt) * (1 - zt * zt)) AS p_xz, (yz - yt * zt) / sqrt((1 - yt * yt) * (1 - zt * zt)) AS p_yz FROM c),
e AS (SELECT w, 'x' AS source, 'y' AS target, (p_xy - p_xz * p_yz) / sqrt((1 - p_xz * p_xz) * (1 - p_yz * p_yz)) AS r, n - 4 AS dof FROM o UNION ALL SELECT w, 'z', 'y', p_yz, n - 3 FROM o UNION ALL SELECT w, 'z', 'x', p_xz, n - 3 FROM o),
t AS (SELECT *, atan(abs(r) / sqrt(1 - r * r)) AS angle, atanh(r) AS mid, 1.959963984540054 / sqrt(dof - 1) AS half FROM e),
p AS (SELECT w, source, target, any_value(r) AS r, any_value(mid) AS mid, any_value(half) AS half, 1 - any_value(angle) * sum(pow(cos(angle * (j + 0.5) / 2000), dof - 1)) / (pi() / 2 * sum(pow(cos(pi() / 2 * (j + 0.5) / 2000), dof - 1))) AS p FROM t, generate_series(0, 1999) g(j) GROUP BY w, source, target),
v AS (SELECT *, CASE WHEN p < 0.05 THEN 'SUPPORTED' WHEN tanh(mid - half) > -0.15 AND tanh(mid + half) < 0.15 THEN 'CONTRADICTED' ELSE 'INCONCLUSIVE' END AS verdict FROM p),
h AS (SELECT source, target, r, p, verdict FROM v WHERE w = -1), q AS (SELECT h.source, h.target, avg(CASE WHEN v.verdict = h.verdict THEN 1.0 ELSE 0.0 END) AS agreement FROM v JOIN h ON v.source = h.source AND v.target = h.target WHERE w >= 0 GROUP BY 1, 2)
SELECT h.source, h.target, CASE WHEN agreement >= 0.75 THEN verdict ELSE 'INCONCLUSIVE' END AS verdict, round(r, 6) AS r, round(p, 5) AS p, round(agreement, 6) AS agreement FROM h JOIN q ON h.source = q.source AND h.target = q.target"""


@query(_SCREEN)
def structure_screen(spark: SparkSession, sf: str) -> DataFrame:
    got = structure.screen(event_days(spark, sf), Dag.of([("x", "y"), ("z", "y"), ("z", "x")]))
    return got.select("source", "target", "verdict", F.round("r", 6).alias("r"), F.round("p", 5).alias("p"), F.round("agreement", 6).alias("agreement"))


@query(f"WITH {_SERIES} SELECT date, greatest(date_diff('day', DATE '{m.T0}', date), 0) AS since, date >= DATE '{m.T0}' AS is_post FROM s", dates="date")
def days_since_intervention(spark: SparkSession, sf: str) -> DataFrame:
    t = F.datediff("date", F.lit(m.T0))
    return monthly(spark, sf).select("date", F.greatest(t, F.lit(0)).cast("long").alias("since"), (t >= 0).alias("is_post"))


@query(f"""WITH {m.SQL_CELLS}, w AS (SELECT cell, month, net_revenue, net_revenue - lag(net_revenue) OVER (PARTITION BY cell ORDER BY month) AS d FROM cells)
SELECT cell, count(d) AS n, round(avg(d), 4) AS mean_step, round(stddev_samp(d), 3) AS sd_step FROM w GROUP BY cell""")
def first_differences(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("cell").orderBy("month")
    got = m.month_cells(spark, sf).withColumn("d", F.col("net_revenue") - F.lag("net_revenue").over(w))
    return got.groupBy("cell").agg(F.count("d").alias("n"), F.round(F.avg("d"), 4).alias("mean_step"), F.round(F.stddev_samp("d"), 3).alias("sd_step"))


@query(f"""WITH {m.SQL_CELLS}, w AS (SELECT cell, month AS date, net_revenue AS value, row_number() OVER (PARTITION BY cell ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY cell) AS n, sum(net_revenue) OVER (PARTITION BY cell ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
 sum(net_revenue) OVER (PARTITION BY cell) AS t FROM cells), q AS (SELECT *, abs((t - a) / (n - i) - a / i) AS gap FROM w WHERE i >= 10 AND i <= n - 11)
SELECT cell, max(n) AS n, count(*) AS n_splits, round(max(gap), 2) AS widest_gap FROM q GROUP BY cell""")
def split_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell's candidate splits and the widest difference of means between two segments."""
    w = Window.partitionBy("cell").orderBy("month")
    every = Window.partitionBy("cell")
    v = F.col("net_revenue")
    got = m.month_cells(spark, sf).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(every), "a": F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), "t": F.sum(v).over(every)})
    least = movement.MIN_SEGMENT
    got = got.where((F.col("i") >= least) & (F.col("i") <= F.col("n") - least - 1))
    gap = F.abs((F.col("t") - F.col("a")) / (F.col("n") - F.col("i")) - F.col("a") / F.col("i"))
    return got.groupBy("cell").agg(F.max("n").alias("n"), F.count("*").alias("n_splits"), F.round(F.max(gap), 2).alias("widest_gap"))
