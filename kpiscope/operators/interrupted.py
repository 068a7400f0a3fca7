"""Interrupted time series for many series at once: level and slope change at a date, HAC errors,
residual diagnostics, the effect in total, and a placebo on the days before, each a group of one plan."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.functions import tails
from kpiscope.operators import regress
from kpiscope.operators.fixed_effects import written

LEAST_BEFORE, LEAST_AFTER, PLACEBO_BEFORE, PLACEBO_DAYS = 20, 5, 40, 21
LEVEL, SLOPE = 2, 3


def design(t: Column, after: Column, since: Column, holiday: Column, promo: Column) -> dict[str, Column]:
    """Constant, trend, level and slope change, two weekly waves, holiday and promotion."""
    waves = {f"{name}{h}": f(2 * math.pi * h * t / 7) for h in (1, 2) for name, f in (("sin", F.sin), ("cos", F.cos))}
    return {"const": F.lit(1.0), "t": t, "after": after, "since": since, **waves, "holiday": holiday, "promo": promo}


def its_many(series: DataFrame, by: Sequence[str], t0: dt.date, y: str = "value", date: str = "date", holiday: str = "is_holiday", promo: str = "is_promo", alpha: float = 0.10) -> DataFrame:
    """One row a series of ``by``: status, n_pre, n_post, level, slope and cumulative (each a struct of estimate, se,
    t, p, low, high), r2, dw, lb, lb_p, placebo and placebo_p.

    A series with fewer than 20 known days before or 5 after is INSUFFICIENT. The placebo takes the
    days before ``t0`` and a change three weeks earlier; it needs 40 days, and as many around its own date
    as any series does. A series is sorted in one task for its lags: one row a day.
    """
    flag = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    known = series.where(F.col(y).isNotNull()).select(*by, F.col(date).alias("_date"), F.col(y).cast("double").alias("_v"), flag(holiday).alias("_holiday"), flag(promo).alias("_promo"))
    known = written(known, "series")
    fake = t0 - dt.timedelta(days=PLACEBO_DAYS)
    d, real, before = F.col("_date"), F.lit(t0), F.lit(fake)
    spans = known.groupBy(*by).agg(
        F.min("_date").alias("_first"), F.count_if(d < real).alias("n_pre"), F.count_if(d >= real).alias("n_post"), F.count_if(d < before).alias("_pre"),
        F.count_if((d >= before) & (d < real)).alias("_post"), F.sum(F.when(d >= real, F.datediff(d, real))).cast("double").alias("_since"),
    )
    fine = (F.col("n_pre") >= LEAST_BEFORE) & (F.col("n_post") >= LEAST_AFTER)
    tried = fine & (F.col("n_pre") >= PLACEBO_BEFORE) & (F.col("_pre") >= LEAST_BEFORE) & (F.col("_post") >= LEAST_AFTER)
    joined = regress._keyed(known, spans, by)
    runs = F.filter(F.array(F.when(fine, F.lit(0)), F.when(tried & (d < real), F.lit(1))), lambda v: v.isNotNull())
    rows = joined.withColumn("_run", F.explode(runs)).withColumn("_t0", F.when(F.col("_run") == 0, real).otherwise(before))
    after = (d >= F.col("_t0")).cast("double")
    x = design(F.datediff(d, "_first").cast("double"), after, F.greatest(F.datediff(d, "_t0"), F.lit(0)) * after, F.col("_holiday"), F.col("_promo"))
    keys = [*by, "_run"]
    residual, plain = regress.fitted(rows, keys, "_v", x)
    residual, plain = written(residual.select(*keys, "_date", "_x", "_u"), "residuals"), written(plain, "fits")
    fits = regress.covariances(residual, plain, keys, len(x), "hac", order="_date")
    tests = regress.residual_tests(residual.where("_run = 0"), keys, "_date")

    def cell(i: int, j: int) -> str:
        return f"cov[{i}][{j}]"

    def whole(estimate: str, variance: str) -> Column:
        return F.struct(*[c.alias(n) for n, c in regress.inferred(estimate, variance, "dof").items()])

    main = regress._keyed(fits.where("_run = 0").select(*by, "dof", "beta", "cov", "r2"), tests.drop("_run"), by)
    level = f"try_divide(beta[{LEVEL}], sqrt(greatest({cell(LEVEL, LEVEL)}, 0D)))"
    other = fits.where("_run = 1").select(*by, tails.t_sf2(level, "dof").alias("placebo_p"))
    got = regress._keyed(regress._keyed(spans, main, by, "left"), other, by, "left")
    total = f"(n_post * beta[{LEVEL}] + _since * beta[{SLOPE}])"
    spread = f"(n_post * n_post * {cell(LEVEL, LEVEL)} + 2 * n_post * _since * {cell(LEVEL, SLOPE)} + _since * _since * {cell(SLOPE, SLOPE)})"
    changes = {"level": whole(f"beta[{LEVEL}]", cell(LEVEL, LEVEL)), "slope": whole(f"beta[{SLOPE}]", cell(SLOPE, SLOPE)), "cumulative": whole(total, spread)}
    placebo = F.when(F.col("placebo_p").isNull(), "INSUFFICIENT").when(F.col("placebo_p") > alpha, "PASS").otherwise("FAIL")
    known_fit = F.col("beta").isNotNull()
    return got.select(
        *by, F.when(fine, "OK").otherwise("INSUFFICIENT").alias("status"), "n_pre", "n_post", *[F.when(known_fit, c).alias(n) for n, c in changes.items()],
        "r2", "dw", "lb", "lb_p", F.when(known_fit, placebo).alias("placebo"), "placebo_p",
    )
