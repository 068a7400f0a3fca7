"""Effect estimators: difference-in-differences and interrupted time series.

On a balanced panel the fixed effects are window averages. Panels with holes of up to
``KERNEL_ROWS`` rows (counted first) go to a numpy kernel, larger ones through alternating
projections over tables (``fixed_effects``). Many interrupted series at once: ``interrupted``.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions import stats
from kpiscope.operators import fixed_effects
from kpiscope.operators.panel import is_balanced

#: All assignments are enumerated up to this many; beyond it a seeded sample is declared.
MAX_ASSIGNMENTS = 20_000
#: Panels of cells and periods of up to so many rows come to the driver; larger ones do not.
KERNEL_ROWS = 50_000


def did_2x2(panel: DataFrame, y: str, treated: str = "treated", post: str = "post") -> DataFrame:
    """Difference of differences of the four means, and the effect as a percentage of the
    treated cells' mean before."""
    def mean(t: bool, p: bool):
        return F.avg(F.when((F.col(treated) == t) & (F.col(post) == p), F.col(y)))

    got = panel.agg(mean(True, True).alias("t1"), mean(True, False).alias("t0"), mean(False, True).alias("c1"), mean(False, False).alias("c0"), F.count("*").alias("n"))
    got = got.withColumn("att", (F.col("t1") - F.col("t0")) - (F.col("c1") - F.col("c0")))
    return got.withColumn("att_pct", 100 * F.try_divide(F.col("att"), F.col("t0")))


def demean(panel: DataFrame, column: str, out: str, cell: str = "cell", period: str = "date", group: str | None = None) -> DataFrame:
    """Cell and (group x) period effects taken out of a balanced panel by three averages."""
    g = [group] if group else []
    by_cell, by_time, every = Window.partitionBy(cell), Window.partitionBy(*g, period), Window.partitionBy(*g)
    v = F.col(column).cast("double")
    return panel.withColumn(out, v - F.avg(v).over(by_cell) - F.avg(v).over(by_time) + F.avg(v).over(every))


def did_balanced(panel: DataFrame, y: str, treated: str = "treated", post: str = "post", cell: str = "cell", period: str = "date", group: str | None = None) -> DataFrame:
    """Two-way fixed effects on a balanced panel: att, its cluster-robust error, t, cells.

    One pass: cells' sums of x y and x x give the estimate and, as a cell's score is
    Sxy - att Sxx, the cluster term as well.
    """
    d = (F.col(treated) & F.col(post)).cast("double")
    both = demean(demean(panel.withColumn("_d", d), y, "_y", cell, period, group), "_d", "_x", cell, period, group)
    return clustered(both, cell)


def clustered(both: DataFrame, cell: str) -> DataFrame:
    """Slope of ``_y`` on ``_x`` and its error clustered by cell, in two aggregations."""
    cells = both.groupBy(cell).agg(F.sum(F.col("_x") * F.col("_y")).alias("sy"), F.sum(F.col("_x") * F.col("_x")).alias("sx"), F.count("*").alias("k"))
    sums = cells.agg(
        F.sum("sy").alias("xy"), F.sum("sx").alias("xx"), F.sum(F.col("sy") * F.col("sy")).alias("yy2"), F.sum(F.col("sy") * F.col("sx")).alias("xy2"),
        F.sum(F.col("sx") * F.col("sx")).alias("xx2"), F.sum("k").alias("n"), F.count("*").alias("g"),
    )
    att = F.try_divide("xy", "xx")
    meat = F.greatest(F.col("yy2") - 2 * att * F.col("xy2") + att * att * F.col("xx2"), F.lit(0.0))
    se = F.sqrt(meat * F.col("g") / (F.col("g") - 1)) / F.col("xx")
    return sums.select(att.alias("att"), se.alias("se"), F.try_divide(att, se).alias("t"), "g", "n")


def parallel_trends_balanced(panel: DataFrame, y: str, treated: str = "treated", post: str = "post", cell: str = "cell", period: str = "date", group: str | None = None) -> DataFrame:
    """The treated cells' extra trend a period before the change, on a balanced panel."""
    order = Window.partitionBy(cell).orderBy(period)
    before = panel.where(~F.col(post)).withColumn("_t", (F.row_number().over(order) - 1) * F.col(treated).cast("double"))
    both = demean(demean(before, y, "_y", cell, period, group), "_t", "_x", cell, period, group)
    return clustered(both, cell)


def _dummies(values: np.ndarray) -> np.ndarray:
    _, at = np.unique(values, return_inverse=True)
    out = np.zeros((len(at), at.max() + 1))
    out[np.arange(len(at)), at] = 1
    return out


def _frame(panel: DataFrame, columns: Sequence[str], cell: str, period: str) -> pd.DataFrame:
    return panel.select(*columns).orderBy(cell, period).toPandas()


def did(panel: DataFrame, y: str, treated: str = "treated", post: str = "post", cell: str = "cell", period: str = "date", group: str | None = None, assignments: bool = True, seed: int = 7) -> dict[str, object]:
    """Cell and (group x) period effects, error clustered by cell with t(G-1), and the
    randomisation p-value over assignments of as many treated cells (the actual one included)."""
    if not _fits(panel, y):
        return _did_relational(panel, y, treated, post, cell, period, group)
    pdf = did_frame(panel, y, treated, post, cell, period, group)
    out, kernel = did_kernel(pdf, y, treated, post, cell, period, group)
    out["path"] = "KERNEL"
    if assignments and kernel is not None:
        out |= randomisation(panel.sparkSession, *kernel, seed)
    return out


def _fits(panel: DataFrame, y: str) -> bool:
    return panel.where(F.col(y).isNotNull()).limit(KERNEL_ROWS + 1).count() <= KERNEL_ROWS


def _did_relational(panel: DataFrame, y: str, treated: str, post: str, cell: str, period: str, group: str | None) -> dict[str, object]:
    """The same estimate without the kernel; assignments are not run, which ``ri_mode`` says."""
    row = fixed_effects.did(panel, y, treated, post, cell, period, group).first().asDict()
    if row["estimate"] is None:
        return {"status": "NOT_ESTIMABLE", "path": "RELATIONAL"}
    before = panel.where(F.col(treated) & ~F.col(post)).agg(F.avg(F.col(y).cast("double"))).first()[0]
    return {"status": "OK", **row, "pct": 100 * row["estimate"] / before if before else None, "path": "RELATIONAL", "ri_p": None, "ri_assignments": 0, "ri_mode": "NOT_RUN"}


def did_frame(panel: DataFrame, y: str, treated: str = "treated", post: str = "post", cell: str = "cell", period: str = "date", group: str | None = None) -> pd.DataFrame:
    cols = list(dict.fromkeys([cell, period, y, treated, post, *([group] if group else [])]))
    return _frame(panel.where(F.col(y).isNotNull()), cols, cell, period)


def did_kernel(pdf: pd.DataFrame, y: str, treated: str = "treated", post: str = "post", cell: str = "cell", period: str = "date", group: str | None = None) -> tuple[dict[str, object], tuple | None]:
    """The estimate on a collected panel, and what the randomisation needs."""
    cells = pdf[cell].to_numpy().astype(str)
    time = pdf[period].astype(str).to_numpy().astype(str)
    if group:
        time = np.char.add(np.char.add(pdf[group].to_numpy().astype(str), "|"), time)
    yy = pdf[y].to_numpy(float)
    if not len(yy):
        return {"status": "NOT_ESTIMABLE"}, None
    basis = stats.orthonormal(np.column_stack([_dummies(cells), _dummies(time)]))
    d = (pdf[treated] & pdf[post]).to_numpy(float)
    y_res, d_res = stats.absorb(basis, yy), stats.absorb(basis, d)
    xx = float(d_res @ d_res)
    names, at = np.unique(cells, return_inverse=True)
    g, n, k = len(names), len(yy), basis.shape[1] + 1
    if xx < 1e-10 or g < 2:
        return {"status": "NOT_ESTIMABLE"}, None
    beta = float(d_res @ y_res) / xx
    sums = np.bincount(at, d_res * (y_res - beta * d_res))
    var = float(sums @ sums) / xx**2 * g / (g - 1) * (n - 1) / max(1, n - k)
    out: dict[str, object] = {"status": "OK", **stats.inference(beta, var, g - 1), "cells": g, "n": n}
    on, after = pdf[treated].to_numpy(bool), pdf[post].to_numpy(bool)
    before = yy[on & ~after]
    out["pct"] = 100 * beta / before.mean() if len(before) and before.mean() else None
    return out, (names, at, after, on, basis, y_res, beta)


def unrank(i: int, n: int, k: int) -> list[int]:
    """The ``i``-th of the k-element subsets of range(n), in lexicographic order."""
    out, x = [], 0
    while k:
        block = math.comb(n - x - 1, k - 1)
        if i < block:
            out.append(x)
            k -= 1
        else:
            i -= block
        x += 1
    return out


def randomisation(spark, names: np.ndarray, at: np.ndarray, post: np.ndarray, treated: np.ndarray, basis: np.ndarray, y_res: np.ndarray, beta: float, seed: int = 7) -> dict[str, object]:
    """p = share of assignments whose estimate is as large as the actual one.

    Assignments are rows; the basis of fixed effects is worked out once and sent along.
    """
    k = len({int(c) for c in at[treated]})
    total = math.comb(len(names), k)
    exact = total <= MAX_ASSIGNMENTS
    sent = spark.sparkContext.broadcast((at, post, basis, y_res, len(names), k))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_, post_, q, yr, g, k_ = sent.value
        for part in parts:
            got = []
            for i in part["id"]:
                if exact:
                    chosen = unrank(int(i), g, k_)
                else:
                    chosen = np.random.default_rng([seed, int(i)]).choice(g, k_, replace=False)
                d = stats.absorb(q, (np.isin(at_, chosen) & post_).astype(float))
                xx = float(d @ d)
                got.append(abs(float(d @ yr) / xx) if xx > 1e-10 else 0.0)
            yield pd.DataFrame({"size": got})

    n = total if exact else MAX_ASSIGNMENTS
    null = spark.range(n).mapInPandas(run, "size double")
    hits = null.where(F.col("size") >= abs(beta) - 1e-12).count()
    return {"ri_p": hits / n if exact else (hits + 1) / (n + 1), "ri_assignments": n, "ri_mode": "EXACT" if exact else "SAMPLED"}


def parallel_trends(panel: DataFrame, y: str, treated: str = "treated", post: str = "post", cell: str = "cell", period: str = "date", group: str | None = None, alpha: float = 0.10) -> dict[str, object]:
    """The treated cells' extra trend before the change; compatible if its p is over alpha."""
    if not _fits(panel, y):
        row = fixed_effects.parallel_trends(panel, y, treated, post, cell, period, group).first().asDict()
        if row["estimate"] is None:
            return {"status": "NOT_ESTIMABLE"}
        return {"status": "COMPATIBLE" if row["p"] > alpha else "VIOLATED", **row}
    cols = list(dict.fromkeys([cell, period, y, treated, *([group] if group else [])]))
    pdf = _frame(panel.where(~F.col(post) & F.col(y).isNotNull()), cols, cell, period)
    if len(pdf) <= 30:
        return {"status": "INSUFFICIENT"}
    cells = pdf[cell].to_numpy().astype(str)
    stamp = pdf[period].astype(str).to_numpy()
    _, index = np.unique(stamp, return_inverse=True)
    time = np.char.add(np.char.add(pdf[group].to_numpy().astype(str), "|"), stamp.astype(str)) if group else stamp
    basis = stats.orthonormal(np.column_stack([_dummies(cells), _dummies(time)]))
    x = stats.absorb(basis, pdf[treated].to_numpy(float) * index)
    yr = stats.absorb(basis, pdf[y].to_numpy(float))
    xx = float(x @ x)
    if xx < 1e-10:
        return {"status": "NOT_ESTIMABLE"}
    b = float(x @ yr) / xx
    u = yr - b * x
    _, at = np.unique(cells, return_inverse=True)
    sums = np.bincount(at, x * u)
    g, n = len(sums), len(yr)
    var = float(sums @ sums) / xx**2 * g / max(1, g - 1) * (n - 1) / max(1, n - basis.shape[1] - 1)
    got = stats.inference(b, var, g - 1)
    return {"status": "COMPATIBLE" if got["p"] > alpha else "VIOLATED", **got}


def estimate_did(panel: DataFrame, y: str, **options) -> dict[str, object]:
    """The relational path where the panel is balanced, else the general one."""
    keys = {k: options[k] for k in ("cell", "period", "group") if k in options}
    if not options.get("assignments", True) and is_balanced(panel, **keys):
        row = did_balanced(panel, y, **{k: v for k, v in options.items() if k != "assignments"}).first()
        return {"status": "OK", "path": "BALANCED", **stats.inference(row["att"], row["se"] ** 2, row["g"] - 1), "cells": row["g"], "n": row["n"]}
    return did(panel, y, **options)


def fourier(t, harmonics: int = 2, period: float = 7.0) -> list:
    """Sine and cosine columns of a day index."""
    return [f(2 * math.pi * h * t / period) for h in range(1, harmonics + 1) for f in (F.sin, F.cos)]


def its_design(dates: Sequence[dt.date], t0: dt.date, holiday: Sequence[bool], promo: Sequence[bool]) -> np.ndarray:
    t = np.array([(d - dates[0]).days for d in dates], float)
    after = np.array([d >= t0 for d in dates], float)
    waves = [f(2 * math.pi * h * t / 7) for h in (1, 2) for f in (np.sin, np.cos)]
    since = np.maximum(t - (t0 - dates[0]).days, 0) * after
    return np.column_stack([np.ones(len(t)), t, after, since, *waves, np.array(holiday, float), np.array(promo, float)])


def its(series: DataFrame, t0: dt.date, y: str = "value", placebo: bool = True, alpha: float = 0.10) -> dict[str, object]:
    """Level and slope change at ``t0`` in a stamped daily series, with HAC errors, residual
    diagnostics, the cumulative effect, and a placebo three weeks earlier on days before t0."""
    pdf = series.where(F.col(y).isNotNull()).select("date", y, "is_holiday", "is_promo").orderBy("date").toPandas()
    dates = list(pdf["date"])
    n_pre = sum(d < t0 for d in dates)
    if n_pre < 20 or len(dates) - n_pre < 5:
        return {"status": "INSUFFICIENT", "n_pre": n_pre, "n_post": len(dates) - n_pre}
    x, v = its_design(dates, t0, pdf["is_holiday"], pdf["is_promo"]), pdf[y].to_numpy(float)
    fit = stats.ols(x, v)
    cov = stats.covariance(fit, "hac")
    level, slope = (stats.inference(float(fit.beta[k]), float(cov[k, k]), fit.dof) for k in (2, 3))
    since = x[x[:, 2] == 1, 3]
    w = np.zeros(x.shape[1])
    w[2], w[3] = len(since), since.sum()
    total = stats.inference(float(w @ fit.beta), float(w @ cov @ w), fit.dof)
    q, q_p = stats.ljung_box(fit.residual)
    out = {"status": "OK", "level": level, "slope": slope, "cumulative": total, "r2": fit.r2(v), "durbin_watson": stats.durbin_watson(fit.residual), "ljung_box": q, "ljung_box_p": q_p, "n_pre": n_pre, "n_post": len(dates) - n_pre}
    if placebo:
        before = series.where(F.col("date") < F.lit(t0))
        if n_pre < 40:
            out["placebo"] = {"status": "INSUFFICIENT"}
        else:
            fake = its(before, t0 - dt.timedelta(days=21), y, placebo=False)
            if fake["status"] == "OK":
                p = fake["level"]["p"]
                out["placebo"] = {"status": "PASS" if p > alpha else "FAIL", "p": p}
            else:
                out["placebo"] = {"status": "INSUFFICIENT"}
    return out


def durbin_watson(residuals: DataFrame, u: str = "u", order: str = "date", by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    step = residuals.withColumn("_d", F.col(u) - F.lag(u).over(w))
    return step.groupBy(*by).agg((F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col(u) * F.col(u))).alias("dw"))


def ljung_box(residuals: DataFrame, u: str = "u", order: str = "date", lags: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """n (n + 2) sum of squared autocorrelations over n - k; its p-value is a driver function."""
    w, every = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    c = residuals.withColumn("_c", F.col(u) - F.avg(u).over(every))
    wide = c.select("*", *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"_p{k}") for k in range(1, lags + 1)])
    sums = wide.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("ss"), *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(1, lags + 1)])
    total = sum((F.pow(F.col(f"_s{k}") / F.col("ss"), 2) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return sums.select(*by, "n", (F.col("n") * (F.col("n") + 2) * total).alias("q"))
