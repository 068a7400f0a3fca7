import datetime as dt

import numpy as np
import pytest
from kpiscope.operators import claims, decompose, estimate, gates, metrics, movement
from kpiscope.operators.decision import RankMisuse, status_from_rank
from kpiscope.operators.graph import Dag, GraphError
from kpiscope.operators.metrics import ContractViolation, Kpi
from pyspark.sql import functions as F


def test_pvm_terms_close(spark):
    cells = spark.createDataFrame([("a", 100.0, 10.0, 150.0, 12.0), ("b", 50.0, 10.0, 40.0, 8.0), ("new", 0.0, 0.0, 30.0, 3.0), ("gone", 20.0, 2.0, 0.0, 0.0)], "c string, v0 double, q0 double, v1 double, q1 double")
    r = decompose.closure_gap(decompose.pvm_terms(cells)).first()
    assert r["volume"] == pytest.approx(0.0) and r["mix"] == pytest.approx(10.0) and r["price"] == pytest.approx(30.0)
    assert r["entry"] == 30.0 and r["exit"] == -20.0 and r["closes"] and r["total"] == pytest.approx(50.0)
    with pytest.raises(ContractViolation):
        decompose.decompose(cells, Kpi("k", "v0", metrics.STOCK), ["c"], F.col("v0"), F.col("q0"), (None, None), (None, None))


def test_ratio_and_stock_windows(spark):
    d = [dt.date(2026, 1, i) for i in (1, 2, 3)]
    s = spark.createDataFrame([(d[0], 1.0, 10.0), (d[1], 9.0, 10.0), (d[2], 1.0, 100.0)], "date date, a double, b double")
    ratio = Kpi("r", "a / b", metrics.RATIO)
    series = metrics.kpi_series(s, ratio)
    assert metrics.window_value(series, ratio, d[0], d[2]).first()[0] == pytest.approx(11 / 120)
    stock = Kpi("s", "12 * a", metrics.STOCK)
    assert metrics.window_value(metrics.kpi_series(s, stock), stock, d[0], d[2]).first()[0] == 12.0
    assert metrics.window_value(series, ratio, dt.date(2027, 1, 1), dt.date(2027, 1, 2)).first()[0] is None


def test_step_is_split_where_it_is(spark):
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(10, 1, 25), rng.normal(14, 1, 15)])
    df = spark.createDataFrame([(dt.date(2026, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)], "date date, value double")
    r = movement.best_split(df).first()
    assert (r["split"], r["n"]) == (25, 40) and movement.split_statistic(y) == (25, pytest.approx(r["stat"]))
    assert movement.best_split(df.limit(20)).first()["split"] == -1
    p = movement.permutation_p(df, n=100).first()
    assert p["p"] == pytest.approx((p["hits"] + 1) / 101) and p["p"] < 0.1
    assert str(movement.permutation_p(df.repartition(3), n=100).first()) == str(p)
    plan = movement.permutation_test(df.repartition(5), n=100).first()
    assert (plan.split, plan.hits, plan.n, plan.p) == (p.split, p.hits, p.n, p.p) and abs(plan.stat - p.stat) < 1e-9


def test_lagged_pair(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=120)
    rows = [(dt.date(2026, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    late = [(d + dt.timedelta(days=3), v) for d, v in rows]
    a, b = (spark.createDataFrame(r, "date date, value double") for r in (rows, late))
    best = gates.best_lag(gates.lag_profile(a, b)).first()
    assert best["lag"] == 3 and best["r"] == pytest.approx(1.0)
    assert int(np.nanargmax(np.abs(gates.lag_correlations(x, np.concatenate([np.full(3, np.nan), x[:-3]]))))) - 14 == 3


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.9), ("d", None)], "hypothesis string, p double")
    got = {r["hypothesis"]: r for r in gates.benjamini_hochberg(p).collect()}
    assert got["a"]["rejected"] and not got["c"]["rejected"] and got["b"]["adjusted"] == pytest.approx(0.06) and "d" not in got


@pytest.mark.parametrize("edges, x, y, want", [
    ([("z", "x"), ("z", "y"), ("x", "y")], "x", "y", ("BACKDOOR", ["z"])),
    ([("x", "c"), ("y", "c"), ("x", "y")], "x", "y", ("BACKDOOR", [])),
    ([("a", "m"), ("b", "m"), ("a", "x"), ("b", "y"), ("x", "y")], "x", "y", ("BACKDOOR", [])),
    ([("x", "m"), ("m", "y")], "x", "y", ("BACKDOOR", [])),
])
def test_strategies(edges, x, y, want):
    got = Dag.of(edges).strategy(x, y)
    assert (got["strategy"], got["set"]) == want


def test_hidden_confounding():
    front = Dag.of([("x", "m"), ("m", "y")], {"u": ["x", "y"]})
    assert front.strategy("x", "y")["strategy"] == "FRONTDOOR" and front.frontdoor_sets("x", "y") == [("m",)]
    iv = Dag.of([("z", "x"), ("x", "y")], {"u": ["x", "y"]})
    assert iv.strategy("x", "y") == {"strategy": "IV", "set": ["z"], "needs": []}
    none = Dag.of([("x", "y")], {"u": ["x", "y"]})
    assert none.strategy("x", "y") == {"strategy": "NONE", "set": [], "needs": ["u"]}
    with pytest.raises(GraphError):
        Dag.of([("a", "b"), ("b", "a")])
    m = Dag.of([("a", "m"), ("b", "m"), ("a", "x"), ("b", "y")])
    assert m.separated("x", "y") and not m.separated("x", "y", ["m"]) and m.separated("x", "y", ["m", "a"])


def test_contract_graph():
    from kpiscope.plans.contract import load

    dag = load().dag
    seen = dag.nodes - dag.unobserved
    assert dag.strategy("on_time_dispatch_rate", "units_sold", seen) == {"strategy": "BACKDOOR", "set": ["seasonality"], "needs": []}
    assert dag.strategy("complaint_rate", "units_sold", seen)["set"] == ["on_time_dispatch_rate"]
    assert dag.strategy("marketing_spend", "units_sold", seen)["set"] == []
    for x in ("competitor_promo", "avg_selling_price"):
        assert dag.strategy(x, "units_sold", seen) == {"strategy": "NONE", "set": [], "needs": ["competitor_promo_intensity"]}


def planted(spark, effect=3.0):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(9):
        for t in range(24):
            y = 10 + c + 0.5 * t + (effect if c < 3 and t >= 12 else 0) + rng.normal(0, 0.3)
            rows.append((f"c{c}", f"l{c % 3}", dt.date(2026, 1, 1) + dt.timedelta(days=t), float(y), c < 3, t >= 12))
    return spark.createDataFrame(rows, "cell string, product_line string, date date, y double, treated boolean, post boolean")


def test_did_paths_agree_and_recover(spark):
    p = planted(spark)
    full = estimate.did(p, "y")
    assert abs(full["estimate"] - 3) < 4 * full["se"] < 0.5 and full["ri_assignments"] == 84 and full["ri_p"] == pytest.approx(1 / 84) and full["cells"] == 9
    flat = estimate.did_balanced(p, "y").first()
    assert flat["att"] == pytest.approx(full["estimate"], abs=1e-9)
    assert estimate.did_2x2(p, "y").first()["att"] == pytest.approx(full["estimate"], abs=1e-9)
    assert estimate.estimate_did(p, "y", assignments=False)["path"] == "BALANCED"
    pdf = p.toPandas()
    x = np.column_stack([estimate._dummies(pdf["cell"].to_numpy()), estimate._dummies(pdf["date"].astype(str).to_numpy())[:, 1:], (pdf["treated"] & pdf["post"]).to_numpy(float)])
    assert np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0][-1] == pytest.approx(full["estimate"], abs=1e-6)
    holes = p.where("not (cell = 'c5' and day(date) = 3)")
    assert estimate.estimate_did(holes, "y", assignments=False)["path"] == "KERNEL"
    assert estimate.parallel_trends(p, "y")["status"] == "COMPATIBLE"


def test_claims_are_held():
    g = claims.build({"x": 12.345, "n": "7 of 9"}, {"marketing_spend": "ASSOCIATION_ONLY"}, ["North"], ["South"], ["headline"], ("Fixed sentence.",), 100)
    ok = {"headline": "Marketing spend was associated with sales (association 12.35). It fell on 2026-08-01 by 9. Fixed sentence."}
    assert claims.validate(ok, g).ok
    faults = {k for k, _ in claims.validate({"drivers": "Marketing spend caused 99 in South."}, g).faults}
    assert faults == {"V1", "V2", "V3", "V4", "V5", "V6"}
    assert claims.render({"headline": "99"}, g)["mode"] == "DEGRADED"
    assert claims.render(ok, g, draft=lambda s: {"headline": "caused"})["mode"] == "TEMPLATE"
    for status, grammar in claims.GRAMMAR.items():
        text = {"headline": "Fulfilment caused the fall, the root cause. Fixed sentence."}
        bad = claims.validate(text, claims.build({}, {"fulfilment": status}, [], [], [], ("Fixed sentence.",), 100)).faults
        assert {"V1"} == {k for k, _ in bad} and any("root cause" in d for _, d in bad) and any("caused" in d for _, d in bad)
        assert not set(grammar.allowed_types) & set(grammar.forbidden_types)
    effect = {"kind": "DID", "estimate": -0.2231435513, "low": -0.3566749439, "high": -0.1053605157}
    said = claims.about({"driver": "fulfilment", "status": "SUPPORTED_BY_DESIGN", "effect": effect})[0].text
    assert "reduced the outcome by 20.00 percent (95 percent interval -30.00 to -10.00)" in said
    assert claims.validate({"drivers": said}, claims.build({"hypotheses": [{"status": "SUPPORTED_BY_DESIGN", "effect": effect}]}, {"fulfilment": "SUPPORTED_BY_DESIGN"}, [], [], [], (), 99)).ok
    low = claims.build({"x": 4.5}, {"spend": "NOT_POINT_IDENTIFIED"}, [], [], [], (), 99)
    assert {k for k, _ in claims.validate({"d": "Spend moved it by 4.50, interval 4.5."}, low).faults} == {"V6"}
    assert claims.type_faults([claims.Statement("drivers", "x", "CAUSAL_EFFECT_CONDITIONAL", "spend")], low.status)[0][0] == "V7"
    assert claims.clarification({"STALE_SOURCE": "a", "CONFOUNDER": "b"})["kind"] == "CONFOUNDER"
    with pytest.raises(RankMisuse):
        status_from_rank(0.9)
