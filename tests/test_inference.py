"""Relational inference against the numpy kernels."""

import datetime as dt
import math

import numpy as np
import pytest
from kpiscope.functions import stats, tails
from kpiscope.operators import estimate, fixed_effects, interrupted, regress, structure
from kpiscope.operators.graph import Dag
from pyspark.sql import functions as F


def test_tails_equal_the_kernels(spark):
    rows = [(float(d), float(t)) for d in (1, 2, 3, 7, 81, 20000) for t in (0.0, 0.1, 1.96, 5, 12, -3)]
    c = spark.createDataFrame(rows, "d double, t double")
    got = c.select("d", "t", tails.t_sf2("t", "d").alias("p"), tails.t_quantile("d").alias("q"), tails.chi2_sf("abs(t) * d / 2", "d").alias("c"), tails.normal_sf2("t").alias("n"), tails.lgamma("d / 2").alias("g"))
    for r in got.collect():
        want = (stats.t_sf2(r.t, r.d), stats.t_quantile(0.975, r.d), stats.chi2_sf(abs(r.t) * r.d / 2, r.d), stats.normal_sf2(r.t), math.lgamma(r.d / 2))
        assert (r.p, r.q, r.c, r.n, r.g) == pytest.approx(want, rel=1e-9, abs=1e-11)
    odd = spark.range(1).select(tails.t_sf2(1.0, 0.0), tails.t_sf2("NULL", 3.0), tails.betainc(2.0, 3.0, 0.0), tails.betainc(2.0, 3.0, 1.0), tails.chi2_sf(0.0, 3.0)).first()
    assert tuple(odd) == (None, None, 0.0, 1.0, 1.0)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    rows = []
    for g in range(4):
        n = (40, 90, 25, 130)[g]
        x, u = r.normal(size=n), 0.0
        for i in range(n):
            u = 0.5 * u + r.normal()
            rows.append((f"g{g}", i, float(i % 7), float(x[i]) if g != 2 else 1.0, float(1000.0 + 2 * x[i] + 0.1 * i + u * (1 + i % 3))))
    return rows


def kernel(rows, g, kind, lags=None):
    mine = [r for r in rows if r[0] == g]
    x = np.array([[1.0, r[1], r[3]] for r in mine])
    fit = stats.ols(x, np.array([r[4] for r in mine]))
    return fit, stats.covariance(fit, kind, np.array([r[2] for r in mine]), lags)


@pytest.mark.parametrize(("kind", "lags"), [("classic", None), ("hc1", None), ("hac", 7), ("hac", None), ("cluster", None)])
def test_many_regressions_equal_the_kernel(spark, data, kind, lags):
    df = spark.createDataFrame(data, "g string, t long, c double, x double, y double").repartition(5)
    design = {"const": F.lit(1.0), "t": F.col("t"), "x": F.col("x")}
    fits = regress.regressions(df, ["g"], "y", design, kind, order="t", lags=lags, cluster="c").cache()
    got = {r.g: r for r in fits.collect()}
    for g in ("g0", "g1", "g3"):
        fit, cov = kernel(data, g, kind, lags)
        assert got[g].beta == pytest.approx(fit.beta.tolist(), rel=1e-8)
        assert np.array(got[g].cov) == pytest.approx(cov, rel=1e-6, abs=1e-12)
        assert got[g].r2 == pytest.approx(fit.r2(np.array([r[4] for r in data if r[0] == g])), rel=1e-8)
    # In g2 the last column is the constant again: it is left out, the fit is that of the others.
    two = [r for r in data if r[0] == "g2"]
    fit = stats.ols(np.array([[1.0, r[1]] for r in two]), np.array([r[4] for r in two]))
    assert got["g2"].rank == 2 and got["g2"].beta == pytest.approx([*fit.beta.tolist(), 0.0], rel=1e-8)
    row = {r.term: r for r in regress.terms(fits, ["g"], list(design)).where("g = 'g1'").collect()}["x"]
    fit, cov = kernel(data, "g1", kind, lags)
    want = stats.inference(float(fit.beta[2]), float(cov[2, 2]), 6 if kind == "cluster" else fit.dof)
    assert {k: row[k] for k in want} == pytest.approx(want, rel=1e-6)


def test_one_group_of_all_rows_and_empty(spark, data):
    df = spark.createDataFrame(data, "g string, t long, c double, x double, y double").where("g = 'g0'")
    design = {"const": F.lit(1.0), "t": F.col("t"), "x": F.col("x")}
    fit, cov = kernel(data, "g0", "hc1")
    got = regress.regressions(df, [], "y", design, "hc1").first()
    assert got.beta == pytest.approx(fit.beta.tolist(), rel=1e-8) and np.array(got.cov) == pytest.approx(cov, rel=1e-6, abs=1e-12)
    assert regress.regressions(df.where("false"), ["g"], "y", design).count() == 0
    rows, _ = regress.fitted(df.withColumn("y", F.when(F.col("t") != 3, F.col("y"))), ["g"], "y", design)
    r = regress.residual_tests(rows, ["g"], "t").first()
    keep = [x for x in data if x[0] == "g0" and x[1] != 3]
    u = stats.ols(np.array([[1.0, x[1], x[3]] for x in keep]), np.array([x[4] for x in keep])).residual
    assert (r.dw, r.lb, r.lb_p) == pytest.approx((stats.durbin_watson(u), *stats.ljung_box(u)), rel=1e-7)
    with pytest.raises(ValueError):
        regress.regressions(df, [], "y", design, "hac")


@pytest.fixture(scope="module")
def holes():
    r = np.random.default_rng(8)
    rows = []
    for c in range(12):
        for t in range(30):
            if r.random() < 0.75:
                on = c % 4 == 0
                y = c + 0.3 * t * (1 + c % 3) + 2.5 * (on and t >= 18) + r.normal()
                rows.append((f"c{c:02}", f"g{c % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=t), float(y) if r.random() < 0.97 else None, on, t >= 18))
    return rows


PANEL = "cell string, line string, date date, y double, treated boolean, post boolean"


def test_fixed_effects_with_holes_equal_the_dense_kernel(spark, holes):
    df = spark.createDataFrame(holes, PANEL).repartition(4)
    got = fixed_effects.did(df, "y", group="line").first()
    want, _ = estimate.did_kernel(estimate.did_frame(df, "y", group="line"), "y", group="line")
    assert (got.cells, got.n) == (want["cells"], want["n"])
    assert {k: got[k] for k in ("estimate", "se", "t", "p", "low", "high")} == pytest.approx({k: want[k] for k in ("estimate", "se", "t", "p", "low", "high")}, rel=1e-8)
    trend = fixed_effects.parallel_trends(df, "y", group="line").first()
    want = estimate.parallel_trends(df, "y", group="line")
    assert {k: trend[k] for k in ("estimate", "se", "p")} == pytest.approx({k: want[k] for k in ("estimate", "se", "p")}, rel=1e-7)


def test_large_panels_take_the_relational_path(spark, holes, monkeypatch):
    df = spark.createDataFrame(holes, PANEL)
    small = estimate.did(df, "y", group="line", assignments=False)
    monkeypatch.setattr(estimate, "KERNEL_ROWS", 10)
    large = estimate.did(df, "y", group="line")
    assert (small["path"], large["path"], large["ri_mode"]) == ("KERNEL", "RELATIONAL", "NOT_RUN")
    assert {k: large[k] for k in ("estimate", "se", "pct")} == pytest.approx({k: small[k] for k in ("estimate", "se", "pct")}, rel=1e-8)
    assert estimate.parallel_trends(df, "y", group="line")["status"] in ("COMPATIBLE", "VIOLATED")


def test_parts_of_a_panel_and_no_variation(spark):
    rows = [("a", "g", dt.date(2020, 1, d), float(d), False, False) for d in (1, 2)] + [("b", "g", dt.date(2020, 1, d), 1.0, False, False) for d in (3, 4)]
    df = spark.createDataFrame(rows, PANEL)
    assert fixed_effects.components(df, ["cell"], ["date"]) == 2
    got = fixed_effects.did(df, "y").first()
    assert got.estimate is None and got.p is None and got.cells == 2
    assert fixed_effects.did(df.where("false"), "y").first().estimate is None


def test_interrupted_series_equal_the_kernel(spark):
    r = np.random.default_rng(2)
    start, t0 = dt.date(2021, 1, 4), dt.date(2021, 5, 1)
    rows = []
    for name, days, lift in (("long", 200, 9.0), ("short", 30, 0.0), ("gaps", 190, -4.0)):
        for i in range(days):
            if name != "gaps" or i % 5:
                d = start + dt.timedelta(days=i)
                rows.append((name, d, float(50 + 0.1 * i + 3 * math.sin(2 * math.pi * i / 7) + lift * (d >= t0) + r.normal()), d.day == 1, d.month == 3))
    df = spark.createDataFrame(rows, "s string, date date, value double, is_holiday boolean, is_promo boolean").repartition(3)
    got = {x.s: x for x in interrupted.its_many(df, ["s"], t0).collect()}
    for name in ("long", "gaps"):
        want, g = estimate.its(df.where(F.col("s") == name), t0), got[name]
        assert (g.status, g.n_pre, g.n_post, g.placebo) == ("OK", want["n_pre"], want["n_post"], want["placebo"]["status"])
        for part in ("level", "slope", "cumulative"):
            assert g[part].asDict() == pytest.approx(want[part], rel=1e-5)
        assert (g.r2, g.dw, g.lb, g.lb_p, g.placebo_p) == pytest.approx((want["r2"], want["durbin_watson"], want["ljung_box"], want["ljung_box_p"], want["placebo"]["p"]), rel=1e-5)
    assert (got["short"].status, got["short"].level, got["short"].placebo) == ("INSUFFICIENT", None, None)
    one = interrupted.its_many(df.where("s = 'long'").drop("s"), [], t0).first()
    assert one.level.estimate == pytest.approx(got["long"].level.estimate, rel=1e-9)


def test_structure_screen_equals_the_kernel(spark):
    r = np.random.default_rng(3)
    n = 160
    z = r.normal(size=n).cumsum()
    x = 0.5 * z + r.normal(size=n)
    y = 2.0 + 0.8 * x - 0.3 * z + 0.02 * np.arange(n) + r.normal(size=n)
    flat = np.full(n, 7.0)
    data = {"x": x, "y": y, "z": z, "u": r.normal(size=n), "flat": flat}
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), *[None if k == "u" and i % 11 == 0 else float(v[i]) for k, v in data.items()]) for i in range(n)]
    panel = spark.createDataFrame(rows, "date date, x double, y double, z double, u double, flat double").repartition(4)
    dag = Dag.of([("x", "y"), ("z", "y"), ("z", "x"), ("u", "y"), ("flat", "x"), ("hidden", "y")])
    got = {(e.source, e.target): e for e in structure.screen(panel, dag).collect()}
    have = list(data)
    table = np.array([[np.nan if v is None else v for v in row[1:]] for row in rows])
    size = max(30, int(0.7 * n))
    starts = np.linspace(0, n - size, structure.WINDOWS).astype(int)
    assert set(got) == {(a, b) for a, b in dag.edges if a in have}
    for (a, b), e in got.items():
        given = structure.conditioning(dag, a, b, have)

        def one(part):
            return structure.partial_correlation(part[:, have.index(a)], part[:, have.index(b)], part[:, [have.index(c) for c in given]])

        whole = one(table)
        verdict = structure.edge_verdict(whole)
        agree = np.mean([structure.edge_verdict(one(table[s : s + size])) == verdict for s in starts])
        assert e.agreement == pytest.approx(agree) and (e.r is None) == (whole["r"] is None)
        if whole["r"] is not None:
            assert (e.r, e.p) == pytest.approx((whole["r"], whole["p"]), rel=1e-6, abs=1e-12)
        assert e.verdict == (verdict if agree >= structure.AGREEMENT or verdict == "NOT_TESTABLE" else "INCONCLUSIVE")
    assert structure.screen(panel.where("false"), dag).where("verdict != 'NOT_TESTABLE'").count() == 0
