"""Each gate and decision on small facts, and the golden behaviour of the four scenarios."""

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from kpiscope.operators import claims, decision, estimate, gates, identify, panel, quality
from kpiscope.operators.graph import Dag
from kpiscope.operators.identify import ASSOCIATION, DESIGN, INSUFFICIENT, NOT_POINT, Hypothesis, Result
from kpiscope.plans import contract, policy
from kpiscope.plans.analysis import SCENARIOS, Engine, conform_bundle, source_freshness
from kpiscope.sources import files, generator
from pyspark.sql import functions as F

from .test_operators import planted

T0 = dt.date(2026, 7, 31)


def test_scope_drops_foreign_regions_and_their_design():
    h = Hypothesis("h", "x", t0=T0, treated=("North", "South"))
    assert identify.scope(h, ["North"]).treated == ("North",) and "DID" in identify.scope(h, ["North"]).designs
    alone = identify.scope(h, ["East"])
    assert alone.treated == () and alone.designs == ("ITS",)


def test_did_eligibility(spark):
    p = planted(spark)
    good = {"status": "COMPATIBLE"}
    assert identify.did_eligible(p, good, True) == (True, [])
    assert identify.did_eligible(p, {"status": "VIOLATED"}, False)[1] == ["PARALLEL_TRENDS", "SPILLOVER"]
    few = p.where("cell in ('c0', 'c5') and date < '2026-01-14' and date > '2026-01-06'")
    assert identify.did_eligible(few, good, True)[1] == ["TREATED_UNITS", "CONTROL_UNITS", "PRE_PERIODS", "POST_PERIODS"]


def test_its_eligibility():
    ok = {"status": "OK", "n_pre": 40, "n_post": 10, "placebo": {"status": "PASS"}, "ljung_box_p": 0.5}
    assert identify.its_eligible(ok, []) == (True, [])
    bad = {**ok, "n_pre": 19, "n_post": 4, "placebo": {"status": "FAIL"}, "ljung_box_p": 0.001}
    assert identify.its_eligible(bad, ["other"])[1] == ["PRE_POINTS", "POST_POINTS", "CONCURRENT_SHOCK", "PLACEBO", "RESIDUAL_AUTOCORRELATION"]
    assert identify.its_eligible({"status": "INSUFFICIENT"}, []) == (False, ["POINTS"])
    got = identify.series_robustness({**ok, "ljung_box_p": 0.001, "durbin_watson": 1.0})
    assert got["PLACEBO"]["pass"] and not got["RESIDUALS"]["pass"]


def test_concurrent_shocks():
    dag, h = Dag.of([("x", "m"), ("m", "y")]), Hypothesis("h", "x", outcome="y")
    at = {"y": T0, "m": T0, "z": T0 + dt.timedelta(days=6), "w": T0 + dt.timedelta(days=7), "v": None}
    assert identify.concurrent_shocks(at, T0, h, dag) == ["z"]


def test_status_only_falls():
    rows = [{"code": "A1", "state": "VIOLATED"}]
    assert identify.downgrade(DESIGN, rows) == ASSOCIATION and identify.downgrade(INSUFFICIENT, rows) == INSUFFICIENT
    assert identify.downgrade(DESIGN, [{"code": "A3", "state": "VIOLATED"}]) == NOT_POINT
    assert identify.downgrade(DESIGN, [{"code": "A5", "state": "VIOLATED"}]) == DESIGN


def test_assumptions_of_unused_designs_do_not_apply():
    t = gates.TemporalVerdict(True, "PASS", 3, 0.6, False)
    did = Result("h", "x", DESIGN, temporal=t, strategy={"strategy": "BACKDOOR"}, did={"eligible": True, "failed": []})
    state = {r["code"]: r["state"] for r in identify.assumptions(did, 95.0)}
    assert state["A6"] == state["A7"] == "NOT_APPLICABLE" and state["A3"] == state["A8"] == "SATISFIED"
    its = Result("h", "x", DESIGN, temporal=t, strategy={"strategy": "NONE"}, its={"eligible": True, "failed": []})
    state = {r["code"]: r["state"] for r in identify.assumptions(its, 40.0)}
    assert state["A2"] == state["A8"] == "VIOLATED" and state["A5"] == "NOT_APPLICABLE" and state["A7"] == "SATISFIED"


def test_no_interval_without_identification():
    t = gates.TemporalVerdict(False, "NO_LEAD", -1, 0.6, False)
    est = {"estimate": 1.0, "se": 0.1, "p": 0.01, "low": 0.8, "high": 1.2, "pct": 3.0, "ri_p": 0.02, "cells": 9}
    assert identify.effect(Result("h", "x", DESIGN, temporal=t, did={"eligible": True, **est}))["kind"] == "DID"
    series = {"eligible": True, "cumulative": est, "level": {"p": 0.04}}
    assert identify.effect(Result("h", "x", DESIGN, temporal=t, its=series)) == {"kind": "ITS", "estimate": 1.0, "se": 0.1, "p": 0.04, "low": 0.8, "high": 1.2}
    assert identify.effect(Result("h", "x", NOT_POINT, temporal=t, did={"eligible": True, **est})) == {"kind": "ASSOCIATION", "r": 0.6, "lag": -1}
    assert identify.effect(Result("h", "x", INSUFFICIENT)) == {"kind": "NONE"}


def test_multiplicity_lowers_what_does_not_survive(spark):
    def one(name, p):
        est = {"estimate": 1.0, "se": 0.1, "p": p, "low": 0.8, "high": 1.2, "pct": 3.0, "ri_p": 0.02, "cells": 9}
        return Result(name, "x", DESIGN, did={"eligible": True, **est}, effect={"kind": "DID", **est})

    a, b = one("a", 0.001), one("b", 0.2)
    got = identify.multiplicity(spark, [a, b, Result("c", "x", INSUFFICIENT)])
    assert got == {"tested": 2, "candidates": 3, "rejected": ["a"]} and a.status == DESIGN and b.status == NOT_POINT
    c, d = one("c", 0.3), one("d", 0.2)
    identify.multiplicity(spark, [c, d])
    assert c.status == d.status == DESIGN  # nothing is rejected, nothing falls


def test_robustness_asks_the_control_outcome_by_randomisation(spark):
    p = planted(spark).withColumn("price", F.lit(5.0) + F.hash("cell", "date") % 100 / 1000.0)
    base = estimate.did(p, "y", group=None)
    got = identify.robustness(p, "y", base, "price")
    assert got["LEAVE_ONE_OUT"]["pass"] and got["NEGATIVE_CONTROL"]["p"] * 84 == pytest.approx(round(got["NEGATIVE_CONTROL"]["p"] * 84))
    assert got["NEGATIVE_CONTROL"]["pass"] == (got["NEGATIVE_CONTROL"]["p"] > 0.10)


def test_subsets_in_order():
    from itertools import combinations

    assert [tuple(estimate.unrank(i, 7, 3)) for i in range(35)] == list(combinations(range(7), 3))


def test_tables_and_arrays_agree_on_lags(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=130)
    y = np.concatenate([rng.normal(size=4), x[:-4]]) + 0.2 * rng.normal(size=130)
    rows = [(dt.date(2026, 1, 1) + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "date date, x double, y double")
    assert gates.lag_stability_table(df, "x", "y").first().asDict() == gates.lag_stability(x, y)
    assert gates.lag_stability_table(df.limit(30), "x", "y").first()["stable"] is False


def test_temporal_columns_equal_the_scalar_rule(spark):
    cases = [(lag, r, stable, res) for lag in (None, -2, 0, 3, 12) for r in (0.1, -0.5) for stable in (True, False) for res in (1.0, 7.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, lag int, r double, stable boolean, res double")
    code, review = gates.temporal_columns(*map(F.col, ("lag", "r", "stable", "res")), (2, 5))
    got = df.select("i", code.alias("code"), review.alias("review")).orderBy("i").collect()
    for row, (lag, r, stable, res) in zip(got, cases):
        want = gates.temporal_verdict(lag, r, {"stable": stable}, res, (2, 5))
        assert (row["code"], row["review"]) == (want.code, want.prior_review)


def test_pre_trend_paths_agree(spark):
    p = planted(spark)
    flat = estimate.parallel_trends_balanced(p, "y").first()
    full = estimate.parallel_trends(p, "y")
    assert flat["att"] == pytest.approx(full["estimate"], abs=1e-9)


def test_ranks_and_latencies_without_one_task(spark):
    from kpiscope.plans.telemetry import latency_summary

    df = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.5), ("d", 0.1)], "hypothesis string, score double")
    assert [r["hypothesis"] for r in decision.rank(df).orderBy("rank").collect()] == ["b", "a", "c", "d"]
    ms = spark.createDataFrame([("x", float(v)) for v in (5, 1, 1, 3, 9, 9)] + [("y", 2.0)], "layer string, ms double")
    got = {r["layer"]: tuple(r)[1:] for r in latency_summary(ms, "layer").collect()}
    assert got == {"x": (1.0, 5.0, 9.0, 6), "y": (2.0, 2.0, 2.0, 1)}


def test_licences(spark):
    rows = [(a, k) for a in (*decision.ALLOWED, "OTHER", None) for k in ("REMEDIATE", "INVESTIGATE", "MONITOR")]
    got = spark.createDataFrame(rows, "a string, k string").withColumn("ok", decision.licensed(F.col("a"), F.col("k"))).where("ok").collect()
    assert {(r["a"], r["k"]) for r in got} == {
        ("REMEDIATE", "REMEDIATE"), ("REMEDIATE_WITH_MONITORING", "REMEDIATE"), ("REMEDIATE_WITH_MONITORING", "MONITOR"),
        ("INVESTIGATE", "INVESTIGATE"), ("INVESTIGATE", "MONITOR"), ("MONITOR", "MONITOR"), ("OTHER", "MONITOR"),
    }
    assert decision.playbooks(spark).count() == 9


def test_freshness_from_a_manifest(spark, tmp_path):
    import json

    def source(at, hours):
        return {"last_refresh_at": at, "expected_cadence_hours": hours, "row_counts": {"t": 1}}

    path = tmp_path / "m.json"
    path.write_text(json.dumps({"as_of": "2026-08-26", "sources": {"A": source("2026-08-25T18:30:00+00:00", 24.0), "B": source("2026-08-24T05:30:00", 24.0), "C": source("2026-08-01T00:00:00", 24.0), "D": source(None, 24.0)}}))
    got = {r["source"]: r for r in source_freshness(files.read_manifest(spark, str(path))).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"A": "CURRENT", "B": "LAGGING", "C": "STALE", "D": "MISSING"}
    assert got["A"]["age_hours"] == pytest.approx(5.5) and got["B"]["age_hours"] == pytest.approx(48.0)
    rows = spark.createDataFrame(list(got.values()))
    assert sorted(r[0] for r in quality.stale_sources(rows).collect()) == ["C", "D"]


def test_words_fit():
    sections = {"headline": "One two three.", "drivers": "Four five. Six seven.", "extra": "Eight nine."}
    assert claims.fit_words(sections, ("headline", "drivers"), 99) == sections
    assert claims.fit_words(sections, ("headline", "drivers"), 7) == {"headline": "One two three.", "drivers": "Four five. Six seven."}
    assert claims.fit_words(sections, ("headline", "drivers"), 5) == {"headline": "One two three.", "drivers": "Four five."}


@pytest.fixture(scope="module")
def engine(spark):
    w = generator.World()
    stale = spark.createDataFrame([("SRC_MKT", "STALE")], "source string, status string")
    return Engine(spark, conform_bundle(generator.bundle(spark, w), w.start, w.end, stale), w.start, w.end, permutations=60)


def test_golden_multifactor(engine):
    a = engine.analyse("SC_MULTIFACTOR", "cfo")
    status = {h["hypothesis_id"]: h for h in a["hypotheses"]}
    assert status["fulfilment"]["status"] == DESIGN and status["fulfilment"]["effect"]["kind"] in ("DID", "ITS")
    assert status["competitor"]["status"] in (NOT_POINT, ASSOCIATION) and status["price"]["status"] in (NOT_POINT, ASSOCIATION)
    assert status["complaints"]["status"] in (NOT_POINT, ASSOCIATION, INSUFFICIENT) and a["abstention"] is None
    assert {"units_sold", "avg_selling_price", "on_time_dispatch_rate", "complaint_rate"} <= set(a["connected"])
    assert any("stale source" in e["statement"] for e in a["evidence"]) and a["cited"]["fulfilment"]
    assert sum(len(t.split()) for t in a["narrative"]["sections"].values()) <= policy.PERSONAS["cfo"].max_words
    assert a["run"]["contract"] == contract.load().digest and a["run"]["row_filter"] == a["regions"]
    stake = status["fulfilment"]["exposure_per_day"]
    assert stake < 0 and math.isfinite(stake)


def test_golden_low_confidence(engine):
    a = engine.analyse("SC_LOWCONF", "finance_analyst")
    assert all(h["status"] != "SUPPORTED_BY_INTERVENTION" for h in a["hypotheses"])
    marketing = next(h for h in a["hypotheses"] if h["hypothesis_id"] == "marketing")
    assert marketing["status"] in (NOT_POINT, ASSOCIATION, INSUFFICIENT)


def test_golden_sparse(engine):
    a = engine.analyse("SC_SPARSE", "cfo")
    assert a["movement"]["pct"] is None and all(h["status"] == INSUFFICIENT for h in a["hypotheses"])
    b = a["benchmark"]
    # The grant is by region, so the benchmark names no line.
    assert not b["named"] and "SmartHome" not in str(b) and b["days"] == 19 and b["ratio"] == pytest.approx(b["per_day"] / b["beside_per_day"])
    assert b["first_value"] > 0 and b["last_value"] > 0
    named = engine.benchmark(SCENARIOS["SC_SPARSE"], replace(engine.decide("t", "subscription_arr", "cfo"), dims=("region", "product_line")))
    assert named["line"] == "SmartHome" and named["per_day"] == pytest.approx(b["per_day"])
    assert a["abstention"] and a["clarification"]["kind"] in ("COVERAGE_GAP", "COARSE_GRAIN", "SPARSE_HISTORY")


def test_golden_security(engine):
    before = len(engine.audit.events)
    with pytest.raises(policy.AccessDenied):
        engine.analyse("SC_SECURITY", "ops_manager", regions=["South"])
    assert len(engine.audit.events) == before + 1
    a = engine.analyse("SC_SECURITY", "ops_manager")
    assert a["regions"] == ["North"] and set(a["connected"]) <= {"units_sold", "avg_selling_price", "on_time_dispatch_rate", "complaint_rate"}
    assert "South" not in str(a["narrative"]["sections"])


def test_nothing_denied_reaches_a_drafter(engine):
    seen = []
    engine.drafter = lambda s: seen.append(s) or s
    try:
        a = engine.analyse("SC_SECURITY", "ops_manager")
        assert a["narrative"]["mode"] in ("MODEL", "TEMPLATE") and seen
        policy.check_payload(seen, policy.decide("ops_manager", "net_revenue", contract.load().rules["net_revenue"]))
    finally:
        engine.drafter = None


def test_a_launched_measure_is_unknown_before(engine):
    p = engine.panel(("North", "West"))
    assert "subscription_arr" in p.columns and p.where("date < '2026-08-07' and subscription_arr is not null").count() == 0
    assert panel.coverage(p, ["subscription_arr"]).first()["status"] in ("SPARSE", "PARTIAL", "ABSENT")
    assert SCENARIOS["SC_LOWCONF"].hypotheses[2].hypothesis_id == "fulfilment"
