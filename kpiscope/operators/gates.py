"""Causal gates: data sufficiency, power, prewhitening, lags, multiplicity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.operators.movement import design_columns, solve

#: Fixed limits of the gates.
MIN_PRE, MIN_POST, MAX_MISSING, MIN_OBSERVED, MIN_CORR = 30, 10, 0.30, 0.50, 0.30


def sufficiency(panel: DataFrame, outcome: str, driver: str, post: str = "is_post") -> DataFrame:
    """One row: counts, shares, and the upper-cased names of failed checks."""
    both = F.col(outcome).isNotNull() & F.col(driver).isNotNull()
    got = panel.agg(
        F.count_if(both & ~F.col(post)).alias("n_pre"), F.count_if(both & F.col(post)).alias("n_post"),
        F.avg(F.col(outcome).isNull().cast("double")).alias("missing_share"), F.avg(F.col(driver).isNotNull().cast("double")).alias("observed_share"),
        F.coalesce(F.var_pop(outcome), F.lit(0.0)).alias("outcome_variance"), F.coalesce(F.var_pop(driver), F.lit(0.0)).alias("driver_variance"),
    )
    failed = F.array_compact(F.array(
        F.when(F.col("n_pre") < MIN_PRE, "PRE_OBSERVATIONS"), F.when(F.col("n_post") < MIN_POST, "POST_OBSERVATIONS"),
        F.when(F.col("missing_share") >= MAX_MISSING, "OUTCOME_MISSING"), F.when(F.col("observed_share") < MIN_OBSERVED, "DRIVER_COVERAGE"),
        F.when(F.col("outcome_variance") <= 0, "OUTCOME_VARIANCE"), F.when(F.col("driver_variance") <= 0, "DRIVER_VARIANCE"),
    ))
    return got.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def power(series: DataFrame, value: str = "value", order: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Lag-1 autocorrelation, effective sample size and minimum detectable effect; unknown for
    20 values and fewer."""
    w = Window.partitionBy(*by).orderBy(order)
    known = series.where(F.col(value).isNotNull()).withColumn("_lag", F.lag(value).over(w))
    got = known.groupBy(*by).agg(F.count("*").alias("n"), F.corr(value, "_lag").alias("rho"), F.stddev_samp(value).alias("sd"))
    n_eff = F.col("n") * (1 - F.col("rho")) / (1 + F.col("rho"))
    enough = F.col("n") > 20
    got = got.withColumn("rho", F.when(enough, F.col("rho"))).withColumn("n_eff", F.when(enough, n_eff))
    return got.withColumn("mde", F.when(enough, 2.8 * F.col("sd") / F.sqrt("n_eff")))


def prewhiten(df: DataFrame, y: str, out: str, date: str = "date") -> DataFrame:
    """Residual on trend and calendar; with too few values, the deviation from the mean."""
    x = design_columns(trend=True, date=date)
    row = df.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.min(date).alias("start")).first()
    if row["n"] < max(15, len(x) + 2):
        return df.withColumn(out, F.col(y) - F.lit(row["mean"]))
    x["trend"] = F.datediff(F.col(date), F.lit(row["start"])).cast("double")
    beta, _ = solve(df, y, x)
    return df.withColumn(out, F.col(y) - sum((F.lit(b) * x[k] for k, b in beta.items()), F.lit(0.0)))


def lag_profile(driver: DataFrame, outcome: DataFrame, most: int = 14, least_pairs: int = 15, date: str = "date") -> DataFrame:
    """Pearson correlation of the driver ``lag`` days before the outcome, for -most..most.

    Each driver row is sent to its 2 x most + 1 target dates (a fixed fan-out), so one equi-join
    serves all lags.
    """
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    x = driver.where("value is not null").select(F.col("value").alias("x"), F.col(date).alias("_d"), lags.alias("lag"))
    x = x.select("x", "lag", F.date_add("_d", F.col("lag")).alias(date))
    y = outcome.where("value is not null").select(date, F.col("value").alias("y"))
    got = x.join(y, date).groupBy("lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    ok = (F.col("n") >= least_pairs) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return got.select("lag", "n", F.when(ok, F.col("r")).alias("r"))


def best_lag(profile: DataFrame) -> DataFrame:
    """The lag of the largest absolute correlation; of equal ones the smallest lag."""
    known = profile.where("r is not null")
    top = F.max(F.struct(F.abs("r").alias("a"), (-F.col("lag")).alias("l"), F.col("r").alias("r")))
    return known.agg(top.alias("t")).select((-F.col("t.l")).alias("lag"), F.col("t.r").alias("r"))


def lag_correlations(x: np.ndarray, y: np.ndarray, most: int = 14, least_pairs: int = 15) -> np.ndarray:
    """The same profile on aligned arrays with NaN for unknown."""
    out = np.full(2 * most + 1, np.nan)
    for i, lag in enumerate(range(-most, most + 1)):
        a, b = (x[: len(x) - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[:lag])
        k = np.isfinite(a) & np.isfinite(b)
        if k.sum() >= least_pairs and a[k].std() > 0 and b[k].std() > 0:
            out[i] = np.corrcoef(a[k], b[k])[0, 1]
    return out


def lag_stability(x: np.ndarray, y: np.ndarray, windows: int = 24, most: int = 14) -> dict[str, object]:
    """Best lags over sliding windows: quartiles, and whether they hold together and lead."""
    n = len(x)
    size = max(40, int(0.7 * n))
    starts = np.unique(np.linspace(0, n - size, windows).astype(int)) if n >= size else []
    lags = []
    for s in starts:
        r = lag_correlations(x[s : s + size], y[s : s + size], most)
        if np.isfinite(r).any():
            lags.append(int(np.nanargmax(np.abs(r))) - most)
    if len(lags) < 5:
        return {"n": len(lags), "stable": False, "q05": None, "q25": None, "q75": None, "q95": None}
    q = [int(v) for v in np.percentile(lags, [5, 25, 75, 95])]
    return {"n": len(lags), "stable": q[2] - q[1] <= 5 and q[1] >= 1, "q05": q[0], "q25": q[1], "q75": q[2], "q95": q[3]}


def lag_stability_table(series: DataFrame, x: str, y: str, windows: int = 24, most: int = 14, least_pairs: int = 15, order: str = "date") -> DataFrame:
    """The same by joins, for a long daily series: one row (n, stable, quartiles).

    Each day meets the days within ``most`` of it (a fixed fan-out), and each such pair the windows
    that hold both (a fixed number); correlations of all windows and lags are one aggregation.
    Correlations that agree to nine decimals are ties, which the smallest lag wins.
    """
    n = series.count()
    size = max(40, int(0.7 * n))
    starts = sorted({(n - size) * k // (windows - 1) for k in range(windows)}) if n >= size else []
    numbered = series.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)  # a row a day
    left = numbered.select(F.col(x).alias("x"), F.col("_i").alias("i"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    pairs = left.withColumn("j", F.col("i") + F.col("lag")).join(numbered.select(F.col(y).alias("y"), F.col("_i").alias("j")), "j").where("x is not null and y is not null")
    first, last = F.least("i", "j"), F.greatest("i", "j")
    held = F.filter(F.array(*map(F.lit, starts)).cast("array<int>"), lambda a: (first >= a) & (last < a + size))
    by = pairs.withColumn("start", F.explode(held)).groupBy("start", "lag").agg(F.count("*").alias("k"), F.corr("x", "y").alias("r"))
    known = by.where((F.col("k") >= least_pairs) & F.col("r").isNotNull() & ~F.isnan("r"))
    top = F.max(F.struct(F.round(F.abs("r"), 9).alias("a"), (-F.col("lag")).alias("l")))
    lags = known.groupBy("start").agg(top.alias("t")).select((-F.col("t.l")).alias("lag"))
    names = ("q05", "q25", "q75", "q95")
    got = lags.agg(F.count("*").alias("n"), *[F.percentile("lag", q).cast("int").alias(c) for c, q in zip(names, (0.05, 0.25, 0.75, 0.95))])
    enough = F.col("n") >= 5
    stable = F.coalesce(enough & (F.col("q75") - F.col("q25") <= 5) & (F.col("q25") >= 1), F.lit(False))
    return got.select("n", stable.alias("stable"), *[F.when(enough, F.col(c)).alias(c) for c in names])


def temporal_columns(lag: Column, r: Column, stable: Column, resolution_days: Column, prior: tuple[int, int] | None = None, min_corr: float = MIN_CORR) -> tuple[Column, Column]:
    """The code of ``temporal_verdict`` and whether the lag asks for review, as columns."""
    unknown = lag.isNull() | r.isNull() | F.isnan(r)
    code = (
        F.when(unknown, "NOT_COMPUTABLE").when(F.abs(r) < min_corr, "ASSOCIATION_TOO_WEAK").when(lag <= 0, "NO_LEAD")
        .when(lag < resolution_days, "GRAIN_TOO_COARSE").when(~stable, "UNSTABLE_LAG").otherwise("PASS")
    )
    review = F.lit(False) if prior is None else ~unknown & ~lag.between(prior[0] - 2, prior[1] + 2)
    return code, review


@dataclass(frozen=True)
class TemporalVerdict:
    passed: bool
    code: str
    lag: int | None
    r: float | None
    prior_review: bool


def temporal_verdict(lag: int | None, r: float | None, stability: dict[str, object], resolution_days: float, prior: tuple[int, int] | None = None, min_corr: float = MIN_CORR) -> TemporalVerdict:
    """Weak, not leading, too coarse and unstable lags fail, in this order; a lag outside the
    prior range by more than two days only asks for review."""
    if lag is None or r is None or math.isnan(r):
        return TemporalVerdict(False, "NOT_COMPUTABLE", None, None, False)
    review = prior is not None and not (prior[0] - 2 <= lag <= prior[1] + 2)
    if abs(r) < min_corr:
        code = "ASSOCIATION_TOO_WEAK"
    elif lag <= 0:
        code = "NO_LEAD"
    elif lag < resolution_days:
        code = "GRAIN_TOO_COARSE"
    elif not stability["stable"]:
        code = "UNSTABLE_LAG"
    else:
        code = "PASS"
    return TemporalVerdict(code == "PASS", code, lag, r, review)


def benjamini_hochberg(p_values: DataFrame, p: str = "p", key: str = "hypothesis", q: float = 0.05, family: Sequence[str] = ()) -> DataFrame:
    """Step-up adjustment within a family; unknown p-values are left out.

    Families are hypotheses of one analysis, so the windows stay small.
    """
    known = p_values.where(F.col(p).isNotNull() & ~F.isnan(p))
    up = Window.partitionBy(*family).orderBy(p, key)
    every = Window.partitionBy(*family)
    got = known.withColumn("rank", F.row_number().over(up)).withColumn("m", F.count("*").over(every))
    down = Window.partitionBy(*family).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    raw = F.least(F.col(p) * F.col("m") / F.col("rank"), F.lit(1.0))
    got = got.withColumn("_adj", F.min(raw).over(down))
    got = got.withColumn("adjusted", F.round("_adj", 6)).withColumn("rejected", F.col("_adj") <= q)
    cut = F.coalesce(F.max(F.when(F.col(p) <= F.col("rank") * q / F.col("m"), F.col(p))).over(every), F.lit(0.0))
    return got.withColumn("threshold", cut).drop("_adj")
