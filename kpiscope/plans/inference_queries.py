"""Queries of the relational estimators: fixed effects with holes, robust errors, interrupted series.

Their SQL is an implementation of its own: systems are swept by a recursion over lists, tails are summed
densities, and alternating projections are a recursion over windows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.operators import fixed_effects, interrupted, regress
from kpiscope.plans import model as m
from kpiscope.plans.registry import registry

QUERIES, SQL = {}, {}
query = registry(QUERIES, SQL)

_NATION = m.SQL_LINES + f""", c AS (SELECT n_name AS nation, r_name AS region, p_type AS product_line, CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(units_shipped - units_returned) AS DOUBLE) AS y
FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
p AS (SELECT nation || ' | ' || product_line AS cell, product_line, month, y, region = '{m.TREATED}' AS treated, month >= DATE '{m.T0}' AS post FROM c)"""


def nation_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Nation x line x month; at small scales many cells lack months."""
    t = m.t
    geo = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    cust = t(spark, sf, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "nation", "region")
    orders = t(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "nation", "region")
    parts = t(spark, sf, "part").select("p_partkey", F.col("p_type").alias("product_line"))
    rows = m.lines(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    got = rows.groupBy("nation", "region", "product_line", F.trunc("date", "month").alias("date")).agg(F.sum(F.col("units_shipped") - F.col("units_returned")).cast("double").alias("y"))
    return got.select(F.concat_ws(" | ", "nation", "product_line").alias("cell"), "product_line", "date", "y", (F.col("region") == m.TREATED).alias("treated"), (F.col("date") >= F.lit(m.T0)).alias("post"))


def _tail(t: str, dof: str) -> str:
    """Two-sided tail of Student's t: what 4000 steps of its density over an angle leave."""
    a = f"atan(abs({t}) / sqrt({dof}::DOUBLE))"
    steps = lambda to: f"list_sum(list_transform(generate_series(0, 3999), lambda j: pow(cos({to} * (j + 0.5) / 4000), {dof} - 1)))"
    return f"(1 - {a} * {steps(a)} / (pi() / 2 * {steps('pi() / 2')}))"


def _within(x: str, rows: str, rounds: int = 120) -> str:
    return f"""WITH RECURSIVE {_NATION}, rows_ AS ({rows}),
a AS (SELECT 0 AS k, cell, product_line, month, y, CAST({x} AS DOUBLE) AS d FROM rows_ UNION ALL SELECT k + 1, cell, product_line, month, y - avg(y) OVER w, d - avg(d) OVER w
 FROM (SELECT k, cell, product_line, month, y - avg(y) OVER c AS y, d - avg(d) OVER c AS d FROM a WHERE k < {rounds} WINDOW c AS (PARTITION BY cell)) WINDOW w AS (PARTITION BY product_line, month)),
e AS (SELECT * FROM a WHERE k = {rounds}), b AS (SELECT sum(y * d) / sum(d * d) AS b, sum(d * d) AS xx, count(*) AS n FROM e),
c2 AS (SELECT cell, sum(d * (y - b * d)) AS s FROM e, b GROUP BY cell), g AS (SELECT sum(s * s) AS meat, count(*) AS cells FROM c2),
r AS (SELECT count(DISTINCT cell) + count(DISTINCT (product_line, month)) - count(DISTINCT product_line) AS rank FROM rows_),
o AS (SELECT b, sqrt(meat * cells / (cells - 1) * (n - 1) / (n - rank - 1)) / xx AS se, cells, n FROM b, g, r)
SELECT round(b, 5) AS estimate, round(se, 5) AS se, round({_tail('b / se', '(cells - 1)')}, 5) AS p, cells, n FROM o"""


def _short(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 5).alias(c) for c in ("estimate", "se", "p")], "cells", "n")


@query(_within("treated AND post", "SELECT * FROM p"))
def did_unbalanced(spark: SparkSession, sf: str) -> DataFrame:
    return _short(fixed_effects.did(nation_panel(spark, sf), "y", group="product_line"))


@query(_within("CAST(treated AS INTEGER) * (dense_rank() OVER (ORDER BY month) - 1)", "SELECT * FROM p WHERE NOT post"))
def pre_trend_unbalanced(spark: SparkSession, sf: str) -> DataFrame:
    return _short(fixed_effects.parallel_trends(nation_panel(spark, sf), "y", group="product_line"))


def _regressions(k: int) -> str:
    """CTEs over ``src`` (key, ord, y, x): fit (key, n, beta, inv, ssr, r2) and u (residuals, with their place)."""
    return f"""g AS (SELECT unnest(generate_series(1, {k})) AS i),
pr AS (SELECT key, a.i, b.i AS j, sum(x[a.i] * x[b.i]) AS v FROM src, g a, g b GROUP BY ALL), sz AS (SELECT key, i, CASE WHEN v > 0 THEN sqrt(v) ELSE 1 END AS z FROM pr WHERE i = j),
m0 AS (SELECT key, list(line ORDER BY i) AS m FROM (SELECT pr.key, pr.i, list(v / (s.z * t.z) ORDER BY pr.j) AS line FROM pr JOIN sz s ON s.key = pr.key AND s.i = pr.i JOIN sz t ON t.key = pr.key AND t.i = pr.j GROUP BY pr.key, pr.i) GROUP BY key),
sw AS (SELECT key, 1 AS k, m FROM m0 UNION ALL SELECT key, k + 1, list_transform(m, lambda line, r: CASE WHEN r = k THEN list_transform(line, lambda v, c: CASE WHEN c = k THEN 1 / m[k][k] ELSE v / m[k][k] END)
 ELSE list_transform(line, lambda v, c: CASE WHEN c = k THEN -line[k] / m[k][k] ELSE v - line[k] * m[k][c] / m[k][k] END) END) FROM sw WHERE k <= {k}),
iv AS (SELECT sw.key, s.i, t.i AS j, m[s.i][t.i] / (s.z * t.z) AS v FROM sw JOIN sz s ON s.key = sw.key JOIN sz t ON t.key = sw.key WHERE k = {k} + 1),
xy AS (SELECT key, i, sum(x[i] * y) AS v FROM src, g GROUP BY ALL), be AS (SELECT key, list(b ORDER BY i) AS beta FROM (SELECT iv.key, iv.i, sum(iv.v * xy.v) AS b FROM iv JOIN xy ON xy.key = iv.key AND xy.i = iv.j GROUP BY iv.key, iv.i) GROUP BY key),
u AS (SELECT src.*, y - list_dot_product(x, beta) AS u, row_number() OVER (PARTITION BY src.key ORDER BY ord) AS place FROM src JOIN be ON be.key = src.key),
fit AS (SELECT u.key, any_value(beta) AS beta, count(*) AS n, sum(u * u) AS ssr, 1 - sum(u * u) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM u JOIN be ON be.key = u.key GROUP BY u.key)"""


def _sandwich(meat: str, factor: str, name: str) -> str:
    """``name`` (key, i, j, v): inverse x meat x inverse x factor."""
    return f"""{name} AS (SELECT a.key, a.i, b.j, sum(a.v * w.v * b.v) * any_value({factor}) AS v FROM iv a JOIN {meat} w ON w.key = a.key AND w.i = a.j JOIN iv b ON b.key = a.key AND b.i = w.j JOIN fit ON fit.key = a.key GROUP BY a.key, a.i, b.j)"""


def _hac(lags: str) -> str:
    """Bartlett-weighted meat over residuals ``u``."""
    return f"""hm AS (SELECT a.key, p.i, q.i AS j, sum((1 - abs(a.place - b.place) / ({lags} + 1.0)) * a.x[p.i] * a.u * b.x[q.i] * b.u) AS v
 FROM u a JOIN fit ON fit.key = a.key JOIN u b ON b.key = a.key AND abs(a.place - b.place) <= {lags}, g p, g q GROUP BY a.key, p.i, q.i)"""


_TERMS = ("const", "trend", "december")
_MONTHS = m.SQL_CELLS + """, s AS (SELECT product_line AS key, month AS ord, sum(units_sold) / 1000.0 AS y FROM cells GROUP BY ALL),
src AS (SELECT key, ord, y, [1.0::DOUBLE, (date_diff('month', DATE '1995-01-01', ord))::DOUBLE, (CASE WHEN month(ord) = 12 THEN 1 ELSE 0 END)::DOUBLE] AS x, year(ord) AS clu FROM s)"""


@query(f"""WITH RECURSIVE {_MONTHS}, {_regressions(3)},
m1 AS (SELECT key, p.i, q.i AS j, sum(x[p.i] * x[q.i] * u * u) AS v FROM u, g p, g q GROUP BY ALL), {_sandwich('m1', 'n / (n - 3.0)', 'v1')}, {_hac('7')}, {_sandwich('hm', 'n / (n - 3.0)', 'v2')},
cs AS (SELECT key, clu, i, sum(x[i] * u) AS s FROM u, g GROUP BY ALL), gc AS (SELECT key, count(DISTINCT clu) AS c FROM u GROUP BY key),
m3 AS (SELECT a.key, a.i, b.i AS j, sum(a.s * b.s) * any_value(c) / (any_value(c) - 1.0) AS v FROM cs a JOIN cs b ON a.key = b.key AND a.clu = b.clu JOIN gc ON gc.key = a.key GROUP BY a.key, a.i, b.i), {_sandwich('m3', '(n - 1) / (n - 3.0)', 'v3')},
o AS (SELECT 'hc1' AS kind, v1.*, n - 3 AS dof FROM v1 JOIN fit ON fit.key = v1.key UNION ALL SELECT 'hac', v2.*, n - 3 FROM v2 JOIN fit ON fit.key = v2.key UNION ALL SELECT 'cluster', v3.*, c - 1 FROM v3 JOIN gc ON gc.key = v3.key)
SELECT o.key AS product_line, kind, ['const', 'trend', 'december'][i] AS term, round(beta[i], 5) AS estimate, round(sqrt(v), 5) AS se, round({_tail('beta[i] / sqrt(v)', 'dof')}, 5) AS p FROM o JOIN fit ON fit.key = o.key WHERE i = j""")
def robust_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's monthly units on a trend and December, with three kinds of errors."""
    months = m.facts(spark, sf).groupBy("product_line", "month").agg((F.sum("units_sold").cast("double") / 1000).alias("y")).withColumn("year", F.year("month"))
    at = F.months_between("month", F.lit(dt.date(1995, 1, 1))).cast("double")
    x = {"const": F.lit(1.0), "trend": at, "december": (F.month("month") == 12).cast("double")}
    out = None
    for kind in ("hc1", "hac", "cluster"):
        fits = regress.regressions(months, ["product_line"], "y", x, kind, order="month", lags=7, cluster="year")
        one = regress.terms(fits, ["product_line"], _TERMS).select("product_line", F.lit(kind).alias("kind"), "term", *[F.round(c, 5).alias(c) for c in ("estimate", "se", "p")])
        out = one if out is None else out.unionByName(one)
    return out


_GRID = """ang AS (SELECT dof, j, sum(w) OVER (PARTITION BY dof ORDER BY j) / sum(w) OVER (PARTITION BY dof) AS c, w / sum(w) OVER (PARTITION BY dof) AS part FROM (SELECT dof, j, pow(cos((j + 0.5) * pi() / 40000), dof - 1) AS w FROM (SELECT DISTINCT dof FROM o), generate_series(0, 19999) t(j))),
q AS (SELECT dof, sqrt(dof::DOUBLE) * tan((j + (0.95 - c + part) / part) * pi() / 40000) AS half FROM ang WHERE c >= 0.95 AND c - part < 0.95)"""
_TESTS = f"""ct AS (SELECT key, place, u, u - avg(u) OVER (PARTITION BY key) AS c, u - lag(u) OVER (PARTITION BY key ORDER BY place) AS d FROM u),
ss AS (SELECT key, count(*) AS n, sum(u * u) AS uu, sum(d * d) AS dd, sum(c * c) AS cc FROM ct GROUP BY key),
ac AS (SELECT a.key, b.place - a.place AS l, sum(a.c * b.c) AS v FROM ct a JOIN ct b ON a.key = b.key AND b.place - a.place BETWEEN 1 AND 10 GROUP BY 1, 2),
lb AS (SELECT ss.key, any_value(dd / uu) AS dw, any_value(n) * (any_value(n) + 2.0) * sum(pow(v / cc, 2) / (n - l)) AS lb FROM ss JOIN ac ON ac.key = ss.key GROUP BY ss.key)"""
#: With ten degrees of freedom the tail is a short sum.
_CHI10 = "exp(-lb / 2) * (1 + lb / 2 + pow(lb / 2, 2) / 2 + pow(lb / 2, 3) / 6 + pow(lb / 2, 4) / 24)"


@query(f"""WITH RECURSIVE {m.SQL_LINES}, s AS (SELECT l_suppkey AS key, CAST(date_trunc('month', date) AS DATE) AS ord, CAST(sum(units_shipped) AS DOUBLE) AS y FROM lines GROUP BY ALL),
src AS (SELECT key, ord, y, [1.0::DOUBLE, date_diff('month', DATE '1995-01-01', ord)::DOUBLE] AS x FROM s), {_regressions(2)}, {_TESTS},
o AS (SELECT fit.key, fit.n, fit.n - 2 AS dof, beta[2] AS b, sqrt(iv.v * ssr / (fit.n - 2)) AS se, r2 FROM fit JOIN iv ON iv.key = fit.key AND iv.i = 2 AND iv.j = 2), {_GRID}
SELECT o.key AS supplier, o.n, round(b, 5) AS slope, round(se, 5) AS se, round({_tail('b / se', 'o.dof')}, 5) AS p, round(b - half * se, 4) AS low, round(b + half * se, 4) AS high, round(r2, 6) AS r2, round(dw, 6) AS dw, round({_CHI10}, 6) AS lb_p
FROM o JOIN q ON q.dof = o.dof JOIN lb ON lb.key = o.key""")
def supplier_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's monthly units on a trend, with tests of the residuals."""
    months = m.lines(spark, sf).groupBy(F.col("l_suppkey").alias("supplier"), F.trunc("date", "month").alias("month")).agg(F.sum("units_shipped").cast("double").alias("y"))
    x = {"const": F.lit(1.0), "trend": F.months_between("month", F.lit(dt.date(1995, 1, 1))).cast("double")}
    trend = regress.terms(regress.regressions(months, ["supplier"], "y", x), ["supplier"], list(x)).where("term = 'trend'")
    rows, _ = regress.fitted(months, ["supplier"], "y", x)
    got = trend.join(regress.residual_tests(rows, ["supplier"], "month"), "supplier")
    return got.select(
        "supplier", "n", F.round("estimate", 5).alias("slope"), F.round("se", 5).alias("se"), F.round("p", 5).alias("p"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"),
        F.round("r2", 6).alias("r2"), F.round("dw", 6).alias("dw"), F.round("lb_p", 6).alias("lb_p"),
    )


def _its(source: str) -> str:
    """``source``: CTEs with s (cell, date, value). A run of each cell at T0, and one of the days before at the placebo's date."""
    t0, fake = m.T0, m.T0 - dt.timedelta(days=interrupted.PLACEBO_DAYS)
    waves = ", ".join(f"{f}({h * 2}.0 * pi() * t / 7)" for h in (1, 2) for f in ("sin", "cos"))
    lags = "floor(4 * pow(fit.n / 100.0, 2.0 / 9))"
    return f"""WITH RECURSIVE {source},
sp AS (SELECT cell, min(date) AS first, count(CASE WHEN date < DATE '{t0}' THEN 1 END) AS n_pre, count(CASE WHEN date >= DATE '{t0}' THEN 1 END) AS n_post, count(CASE WHEN date < DATE '{fake}' THEN 1 END) AS f_pre,
 count(CASE WHEN date >= DATE '{fake}' AND date < DATE '{t0}' THEN 1 END) AS f_post, sum(CASE WHEN date >= DATE '{t0}' THEN date_diff('day', DATE '{t0}', date) END) AS since FROM s GROUP BY cell),
ok AS (SELECT * FROM sp WHERE n_pre >= 20 AND n_post >= 5),
ru AS (SELECT s.cell, 'real' AS run, date, value, DATE '{t0}' AS began, first FROM s JOIN ok ON ok.cell = s.cell UNION ALL SELECT s.cell, 'fake', date, value, DATE '{fake}', first FROM s JOIN ok ON ok.cell = s.cell WHERE date < DATE '{t0}' AND n_pre >= 40 AND f_pre >= 20 AND f_post >= 5),
rt AS (SELECT *, date_diff('day', first, date)::DOUBLE AS t, CASE WHEN date >= began THEN 1.0 ELSE 0.0 END::DOUBLE AS post, greatest(date_diff('day', began, date), 0)::DOUBLE AS since FROM ru),
src AS (SELECT (cell, run) AS key, date AS ord, value AS y, [1.0::DOUBLE, t, post, since, {waves}, (CASE WHEN month(date) = 12 THEN 1 ELSE 0 END)::DOUBLE, (CASE WHEN month(date) = 8 THEN 1 ELSE 0 END)::DOUBLE] AS x FROM rt),
{_regressions(10)}, {_hac(lags)}, {_sandwich('hm', 'n / (n - 10.0)', 'cv')}, {_TESTS},
w AS (SELECT key, any_value(CASE WHEN i = 3 AND j = 3 THEN v END) AS ll, any_value(CASE WHEN i = 3 AND j = 4 THEN v END) AS ls, any_value(CASE WHEN i = 4 AND j = 4 THEN v END) AS vs FROM cv GROUP BY key),
f AS (SELECT fit.key[1] AS cell, fit.key[2] AS run, beta[3] AS level, sqrt(ll) AS level_se, beta[4] AS slope, sqrt(vs) AS slope_se, ll, ls, vs, fit.n - 10 AS dof, r2, dw, lb FROM fit JOIN w ON w.key = fit.key JOIN lb ON lb.key = fit.key),
o AS (SELECT * FROM f WHERE run = 'real'), pl AS (SELECT cell, {_tail('level / level_se', 'dof')} AS p FROM f WHERE run = 'fake')
SELECT sp.cell, CASE WHEN o.cell IS NULL THEN 'INSUFFICIENT' ELSE 'OK' END AS status, n_pre, n_post, round(level, 3) AS level, round(level_se, 3) AS level_se, round({_tail('level / level_se', 'dof')}, 5) AS level_p, round(slope, 5) AS slope, round(slope_se, 5) AS slope_se,
 round(n_post * level + since * slope, 1) AS cumulative, round(sqrt(n_post * n_post * ll + 2 * n_post * since * ls + since * since * vs), 1) AS cumulative_se, round(r2, 5) AS r2, round(dw, 5) AS dw, round({_CHI10}, 5) AS lb_p,
 CASE WHEN o.cell IS NOT NULL THEN CASE WHEN pl.p IS NULL THEN 'INSUFFICIENT' WHEN pl.p > 0.10 THEN 'PASS' ELSE 'FAIL' END END AS placebo, round(pl.p, 5) AS placebo_p
FROM sp LEFT JOIN o ON o.cell = sp.cell LEFT JOIN pl ON pl.cell = sp.cell"""


def _flat(df: DataFrame, by: list[str]) -> DataFrame:
    r = lambda c, n: F.round(c, n)
    cols: dict[str, Column] = {
        "level": r("level.estimate", 3), "level_se": r("level.se", 3), "level_p": r("level.p", 5), "slope": r("slope.estimate", 5), "slope_se": r("slope.se", 5),
        "cumulative": r("cumulative.estimate", 1), "cumulative_se": r("cumulative.se", 1), "r2": r("r2", 5), "dw": r("dw", 5), "lb_p": r("lb_p", 5), "placebo_p": r("placebo_p", 5),
    }
    return df.select(*by, "status", "n_pre", "n_post", *[c.alias(n) for n, c in cols.items()], "placebo")


@query(_its(m.SQL_CELLS + ", s AS (SELECT cell, month AS date, units_sold AS value FROM cells)"))
def its_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Every region and line's months around the change, with August and December as flags."""
    s = m.month_cells(spark, sf).select("cell", F.col("month").alias("date"), F.col("units_sold").alias("value")).withColumns({"is_holiday": F.month("date") == 12, "is_promo": F.month("date") == 8})
    return _flat(interrupted.its_many(s, ["cell"], m.T0), ["cell"])


@query(_its(f"{m.SQL_LINES}, s AS (SELECT 'all' AS cell, CAST(date_trunc('month', date) AS DATE) AS date, CAST(sum(gross_sales) AS DOUBLE) / 1000000 AS value FROM lines GROUP BY ALL)"))
def its_hac(spark: SparkSession, sf: str) -> DataFrame:
    """All months' gross sales, in millions, as one series."""
    s = m.lines(spark, sf).groupBy(F.trunc("date", "month").alias("date")).agg((F.sum("gross_sales").cast("double") / 1e6).alias("value"))
    s = s.withColumns({"is_holiday": F.month("date") == 12, "is_promo": F.month("date") == 8})
    return _flat(interrupted.its_many(s, [], m.T0).withColumn("cell", F.lit("all")), ["cell"])


#: Days are enough before the change for a placebo.
_WEEKS = m.SQL_LINES + ", s AS (SELECT r_name AS cell, date, CAST(sum(units_shipped) AS DOUBLE) AS value FROM lines JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"


@query(_its(_WEEKS))
def its_daily_placebo(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier region's days; the placebo is tested here."""
    geo = m.t(spark, sf, "nation").join(m.t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = m.t(spark, sf, "supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("cell"))
    rows = m.lines(spark, sf).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    s = rows.groupBy("cell", "date").agg(F.sum("units_shipped").cast("double").alias("value")).withColumns({"is_holiday": F.month("date") == 12, "is_promo": F.month("date") == 8})
    return _flat(interrupted.its_many(s, ["cell"], m.T0), ["cell"])
