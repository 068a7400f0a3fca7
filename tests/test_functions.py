import datetime as dt


import numpy as np
import pytest
from kpiscope.functions import calendar as cal
from kpiscope.functions import scalars, stats
from kpiscope.functions.formula import FormulaError, apply_formula, compile_formula
from kpiscope.operators import quality
from pyspark.sql import functions as F


def test_calendar_days(spark):
    rows = spark.createDataFrame([(dt.date(2026, 8, 15),), (dt.date(2026, 3, 31),), (dt.date(2026, 4, 1),), (dt.date(2026, 12, 31),), (dt.date(2026, 8, 16),), (dt.date(2026, 8, 17),)], "date date")
    got = {r["date"]: r for r in cal.stamp(rows).collect()}
    assert got[dt.date(2026, 3, 31)]["fiscal_period"] == "FY26-P12" and got[dt.date(2026, 4, 1)]["fiscal_period"] == "FY27-P01"
    assert got[dt.date(2026, 12, 31)]["fiscal_quarter"] == "FY27-Q3" and got[dt.date(2026, 8, 15)]["holiday"] == "Independence Day"
    sunday, monday = got[dt.date(2026, 8, 16)], got[dt.date(2026, 8, 17)]
    assert sunday["iso_week_start"] == dt.date(2026, 8, 10) and sunday["fiscal_week_start"] == dt.date(2026, 8, 16)
    assert monday["iso_week_start"] == dt.date(2026, 8, 17) and monday["fiscal_week_start"] == dt.date(2026, 8, 16)
    assert sunday["conflicts"] == ["WEEK_START_MISMATCH", "BASELINE_BLACKOUT"] and not sunday["baseline_eligible"]
    assert cal.days(spark, dt.date(2026, 1, 2), dt.date(2026, 1, 1)).count() == 0


def test_formulas(spark):
    df = spark.createDataFrame([(6.0, 2.0), (1.0, 0.0)], "a double, b double")
    assert [r["x"] for r in apply_formula(df, "-(a - 2*b) / b + 1", "x").collect()] == [0.0, None]
    for bad in ("a.b", "f(a)", "a if b else a", "'x'", "a ** 2", "a; b", "True", "c + a", "__import__('os')"):
        with pytest.raises(FormulaError):
            compile_formula(bad, ["a", "b"])
    with pytest.raises(FormulaError):
        apply_formula(df, "a + missing", "x")


def test_tails_against_known_values():
    assert stats.normal_sf2(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert stats.t_sf2(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_sf2(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.2281388519, abs=1e-8)
    assert stats.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)


def test_covariances_on_small_data():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(40), rng.normal(size=40)])
    y = x @ [1.0, 2.0] + rng.normal(size=40)
    fit = stats.ols(x, y)
    assert np.allclose(stats.covariance(fit, "hac", lags=0), stats.covariance(fit, "hc1"))
    own = stats.covariance(fit, "cluster", clusters=np.arange(40))
    assert np.allclose(own, stats.covariance(fit, "hc1") * (40 / 39) * (39 / 38) / (40 / 38))


def test_timestamps(spark):
    raw = ["2026-08-01T10:00:00+05:30", "2026-08-01T10:00:00", "1785558600000", "", None, "junk", "1785558600", "2026-08-01T04:30:00Z"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [tuple(r)[1:] for r in df.select("i", quality.timestamp_convention(F.col("raw")).alias("k"), F.date_format(quality.normalise_timestamp(F.col("raw")), "yyyy-MM-dd HH:mm").alias("t")).orderBy("i").collect()]
    same = "2026-08-01 04:30"
    assert got == [("ISO_OFFSET", same), ("NAIVE_LOCAL", same), ("EPOCH_MS", same), ("EMPTY", None), ("EMPTY", None), ("UNPARSEABLE", None), ("UNPARSEABLE", None), ("ISO_OFFSET", same)]


def test_scalars(spark):
    got = spark.range(1).select(scalars.numbers_in(F.lit("a -1,234.5 and +7")).alias("n"), scalars.money(F.lit(-2.5e7)).alias("m"), scalars.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("z"), scalars.crosses(F.lit(-6.0), 5, "down").alias("c")).first()
    assert got["n"] == [-1234.5, 7.0] and got["m"] == "-2.50 crore" and got["z"] is None and got["c"]
    df, gone = scalars.drop_denied(spark.createDataFrame([(1, 2)], "a int, b int"), ["b", "z"])
    assert df.columns == ["a"] and gone == ["b"]


def test_money_rounds_exact_binary_values(spark):
    values = [6210050000.0, 11250000.0, -11350000.0, 100500.0, 112500.0, -1e12, 0.5, 1.5, 99999.5, -0.3, -0.0, 12345.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["m"] for r in df.orderBy("i").select(scalars.money(F.col("v")).alias("m")).collect()]
    want = [f"{v / 1e7:.2f} crore" if abs(v) >= 1e7 else f"{v / 1e5:.2f} lakh" if abs(v) >= 1e5 else f"{round(v):,}" for v in values]
    assert got == want and got[:2] == ["621.00 crore", "1.12 crore"]
