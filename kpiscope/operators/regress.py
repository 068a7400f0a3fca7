"""Least squares for many groups at once, with classic and robust errors, all in the plan.

Each group's normal equations are sums of one aggregation, swept to an inverse by a fold over
arrays; nothing of a group but its few sums meets in a task. Robust errors take a second
aggregation, of outer products of scores: within rows (hc1), within rows and with earlier
ones (hac, Bartlett weights), or of their sums by cluster.

Expressions over matrices are SQL texts: an array of rows each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions import tails

#: A column that others explain but for this share of its square is left out (coefficient 0).
TOLERANCE = 1e-10
KINDS = ("classic", "hc1", "hac", "cluster")
#: Lags of hac at most, where none are given: those of 50 000 rows.
MOST_LAGS = 16


def swept(matrix: str, k: int) -> str:
    """Inverse of a symmetric positive matrix of size k, by sweeping each pivot in turn. Rows and columns of
    pivots within the tolerance of zero stay zero."""
    pivot = "m[i - 1][i - 1]"
    own = f"transform(m[i - 1], (v, c) -> if(c = i - 1, 1 / {pivot}, v / {pivot}))"
    other = f"transform(row, (v, c) -> if(c = i - 1, -row[i - 1] / {pivot}, v - row[i - 1] * m[i - 1][c] / {pivot}))"
    fine = f"transform(m, (row, r) -> if(r = i - 1, {own}, {other}))"
    gone = "transform(m, (row, r) -> transform(row, (v, c) -> if(r = i - 1 OR c = i - 1, 0D, v)))"
    return f"aggregate(sequence(1, {k}), {matrix}, (m, i) -> if({pivot} > {TOLERANCE!r}D, {fine}, {gone}))"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v)"


def times(m: str, v: str) -> str:
    return f"transform({m}, line -> {dot('line', v)})"


def matmul(a: str, b: str) -> str:
    """a b, for a symmetric ``b``: its columns are its rows."""
    return f"transform({a}, line -> transform({b}, col -> {dot('line', 'col')}))"


def _symmetric(k: int, cell: str = "_{i}_{j}") -> str:
    """Rows of a symmetric matrix from columns named for i <= j."""
    return "array(" + ", ".join("array(" + ", ".join(cell.format(i=min(i, j), j=max(i, j)) for j in range(k)) + ")" for i in range(k)) + ")"


def _pairs(k: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(k), 2))


def _keyed(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by the group; without groups the right side is one row."""
    return left.join(right, list(by), how) if by else left.join(F.broadcast(right), F.lit(True), how)


def moments(df: DataFrame, by: Sequence[str], y: str, x: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with _x and _y, sums by group): only rows where y and all of x are known count."""
    k = len(x)
    rows = df.withColumns({"_y": F.col(y).cast("double"), "_x": F.array(*[c.cast("double") for c in x.values()])})
    rows = rows.where("_y IS NOT NULL AND NOT exists(_x, v -> v IS NULL)")
    sums = [f"sum(_x[{i}] * _x[{j}]) AS _{i}_{j}" for i, j in _pairs(k)] + [f"sum(_x[{i}] * _y) AS _y{i}" for i in range(k)]
    return rows, rows.groupBy(*by).agg(*map(F.expr, ["count(*) AS n", "sum(_y) AS _sy", "sum(_y * _y) AS _syy", *sums]))


def solved(sums: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(by, n, rank, beta, inverse, _sy, _syy): columns are brought to like size before the sweep."""
    s = sums.withColumn("_size", F.expr("array(" + ", ".join(f"if(_{i}_{i} > 0, sqrt(_{i}_{i}), 1D)" for i in range(k)) + ")"))
    like = "transform({m}, (line, r) -> transform(line, (v, c) -> v / (_size[r] * _size[c])))"
    s = s.withColumn("_inv", F.expr(swept(like.format(m=_symmetric(k)), k))).withColumn("inverse", F.expr(like.format(m="_inv")))
    s = s.withColumn("beta", F.expr(times("inverse", "array(" + ", ".join(f"_y{i}" for i in range(k)) + ")")))
    rank = F.expr("CAST(size(filter(_inv, line -> exists(line, v -> v != 0))) AS BIGINT)")
    return s.select(*by, "n", rank.alias("rank"), "beta", "inverse", "_sy", "_syy")


def fitted(df: DataFrame, by: Sequence[str], y: str, x: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with the residual _u, fits with beta, inverse, n and rank)."""
    rows, sums = moments(df, by, y, x)
    fits = solved(sums, by, len(x))
    rows = _keyed(rows, fits.select(*by, "beta"), by)
    return rows.withColumn("_u", F.expr(f"_y - {dot('_x', 'beta')}")).drop("beta"), fits


def meat(rows: DataFrame, by: Sequence[str], k: int, kind: str, order: str | None = None, lags: int | None = None, cluster: str | None = None) -> DataFrame:
    """(by, ssr, _g, _meat): squared residuals, clusters, outer products of scores."""
    ssr, pairs = "sum(_u * _u) AS ssr", _pairs(k)
    if kind == "classic":
        return rows.groupBy(*by).agg(F.expr(ssr), F.lit(0).cast("long").alias("_g"))
    scores = [f"_x[{i}] * _u AS _s{i}" for i in range(k)]
    if kind == "cluster":
        sums = rows.groupBy(*by, cluster).agg(F.expr(ssr), *[F.expr(f"sum(_x[{i}] * _u) AS _s{i}") for i in range(k)])
        out = sums.groupBy(*by).agg(*map(F.expr, ["sum(ssr) AS ssr", "count(*) AS _g", *[f"sum(_s{i} * _s{j}) AS _{i}_{j}" for i, j in pairs]]))
    elif kind == "hc1":
        s = rows.select(*by, "_u", *map(F.expr, scores))
        out = s.groupBy(*by).agg(*map(F.expr, [ssr, "0L AS _g", *[f"sum(_s{i} * _s{j}) AS _{i}_{j}" for i, j in pairs]]))
    else:
        every = Window.partitionBy(*by)
        most = F.lit(lags) if lags is not None else F.least(F.floor(4 * F.pow(F.count("*").over(every) / 100, 2 / 9)), F.lit(MOST_LAGS))
        past = F.collect_list("_s").over(every.orderBy("_o").rowsBetween(-(MOST_LAGS if lags is None else lags), -1))
        s = rows.select(*by, "_u", F.col(order).alias("_o"), most.alias("_most"), F.expr("transform(_x, v -> v * _u)").alias("_s"))
        # What each score meets of earlier ones, the nearest weighing most.
        s = s.withColumn("_past", F.reverse(past)).withColumn(
            "_p", F.expr(f"aggregate(transform(_past, (e, l) -> transform(e, v -> v * greatest(1 - (l + 1) / (_most + 1), 0D))), array_repeat(0D, {k}), (a, e) -> zip_with(a, e, (p, q) -> p + q))")
        )
        out = s.groupBy(*by).agg(*map(F.expr, [ssr, "0L AS _g", *[f"sum(_s[{i}] * _s[{j}] + _s[{i}] * _p[{j}] + _s[{j}] * _p[{i}]) AS _{i}_{j}" for i, j in pairs]]))
    return out.select(*by, "ssr", "_g", F.expr(_symmetric(k)).alias("_meat"))


def regressions(df: DataFrame, by: Sequence[str], y: str, x: Mapping[str, Column], kind: str = "classic", order: str | None = None, lags: int | None = None, cluster: str | None = None) -> DataFrame:
    """(by, n, rank, dof, beta, cov, ssr, r2): one regression a group.

    ``kind``: classic, hc1, hac (``order`` within a group, ``lags`` or 4 (n / 100)^(2 / 9), at most 16), cluster.
    Degrees of freedom are n - rank, or clusters - 1. ``by`` may be empty. For hac a group is sorted in one
    task: it should be a series, one row a day.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown covariance {kind!r}")
    if kind == "hac" and order is None or kind == "cluster" and cluster is None:
        raise ValueError(f"{kind} needs {'an order' if kind == 'hac' else 'clusters'}")
    rows, fits = fitted(df, by, y, x)
    return covariances(rows, fits, by, len(x), kind, order, lags, cluster)


def covariances(rows: DataFrame, fits: DataFrame, by: Sequence[str], k: int, kind: str, order: str | None = None, lags: int | None = None, cluster: str | None = None) -> DataFrame:
    """What ``regressions`` gives, from the rows and fits of ``fitted``."""
    got = _keyed(fits, meat(rows, by, k, kind, order, lags, cluster), by)
    left = "greatest(n - rank, 1)"
    factor = {"classic": f"ssr / {left}", "hc1": f"n / {left}", "hac": f"n / {left}", "cluster": f"_g / greatest(_g - 1, 1) * (n - 1) / {left}"}[kind]
    sandwich = "inverse" if kind == "classic" else matmul(matmul("inverse", "_meat"), "inverse")
    got = got.withColumn("_f", F.expr(factor)).withColumn("cov", F.expr(f"transform({sandwich}, line -> transform(line, v -> v * _f))"))
    total = "(_syy - _sy * _sy / n)"
    return got.select(*by, "n", "rank", F.expr("_g - 1" if kind == "cluster" else "n - rank").alias("dof"), "beta", "cov", "ssr", F.expr(f"if({total} > 0, 1 - ssr / {total}, NULL)").alias("r2"))


def inferred(estimate: str, variance: str, dof: str, level: float = 0.95) -> dict[str, Column]:
    """se, t, p, low and high of an estimate (SQL texts), by Student's t."""
    se = f"sqrt(greatest({variance}, 0D))"
    t = f"try_divide({estimate}, {se})"
    half = f"({tails.t_quantile_sql(dof, level)} * {se})"
    texts = {"estimate": estimate, "se": se, "t": t, "p": tails.t_sf2_sql(t, dof), "low": f"{estimate} - {half}", "high": f"{estimate} + {half}"}
    return {k: F.expr(v) for k, v in texts.items()}


def terms(fits: DataFrame, by: Sequence[str], names: Sequence[str], level: float = 0.95) -> DataFrame:
    """One row a group and term, with its inference."""
    each = fits.select("*", F.posexplode(F.array(*map(F.lit, names))).alias("_at", "term"))
    each = each.withColumns({"_b": F.expr("beta[_at]"), "_v": F.expr("cov[_at][_at]")})
    return each.select(*by, "term", *[c.alias(n) for n, c in inferred("_b", "_v", "dof", level).items()], "n", "dof", "r2")


def residual_tests(rows: DataFrame, by: Sequence[str], order: str, lags: int = 10) -> DataFrame:
    """(by, dw, lb, lb_p): Durbin-Watson, Ljung-Box and its p-value of each group's residuals ``_u``."""
    w, every = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    c = rows.select(*by, order, "_u", (F.col("_u") - F.avg("_u").over(every)).alias("_c"), (F.col("_u") - F.lag("_u").over(w)).alias("_d"))
    c = c.withColumn("_past", F.reverse(F.collect_list("_c").over(w.rowsBetween(-lags, -1))))
    near = [f"sum(_c * get(_past, {j - 1})) AS _p{j}" for j in range(1, lags + 1)]
    sums = c.groupBy(*by).agg(*map(F.expr, ["count(*) AS _n", "sum(_u * _u) AS _uu", "sum(_d * _d) AS _dd", "sum(_c * _c) AS _cc", *near]))
    most = f"least({lags}, _n - 1)"
    q = " + ".join(f"if({j} <= {most}, pow(try_divide(_p{j}, _cc), 2) / (_n - {j}), 0D)" for j in range(1, lags + 1))
    s = sums.withColumn("lb", F.expr(f"_n * (_n + 2) * ({q})"))
    return s.select(*by, F.expr("try_divide(_dd, _uu)").alias("dw"), "lb", tails.chi2_sf("lb", most).alias("lb_p"))
