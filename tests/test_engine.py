import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from kpiscope.operators import estimate
from kpiscope.operators.metrics import ContractViolation, comparable
from kpiscope.plans import contract, policy
from kpiscope.plans.analysis import Engine, conform_bundle
from kpiscope.plans.service import Service
from kpiscope.sources import files, generator
from kpiscope.streaming import ops_stream
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def engine(spark):
    w = generator.World()
    return Engine(spark, conform_bundle(generator.bundle(spark, w), w.start, w.end), w.start, w.end, permutations=60)


def test_contract_faults_are_found():
    spec = dict(contract.load().raw)
    kpis = {k: dict(v) for k, v in spec["kpis"].items()}
    kpis["net_revenue"]["not_interchangeable_with"] = []
    kpis["units_sold"] = {**kpis["units_sold"], "formula": "a.b(c)", "calendar": "NOPE", "time_aggregation": "SUM"}
    with pytest.raises(ContractViolation) as e:
        contract.build({**spec, "kpis": kpis})
    assert all(x in str(e.value) for x in ("not the other way round", "NOPE", "SUM"))
    assert len(contract.load().digest) == 16


def test_access_is_closed_by_default():
    rules = contract.load().rules
    def code(*a, **k):
        return policy.decide(*a, **k).code

    assert code("nobody", "net_revenue", rules["net_revenue"]) == "UNKNOWN_PERSONA"
    assert code("ops_manager", "gross_revenue", rules["gross_revenue"]) == "KPI_OUT_OF_DOMAIN"
    assert code("cfo", "net_revenue", {}) == "NO_CONTRACT_RULE"
    assert code("ops_manager", "net_revenue", rules["net_revenue"], regions=["South"]) == "ROW_SCOPE"
    assert code("cfo", "net_revenue", rules["net_revenue"], grain="day x region x product_line") == "GRAIN_TOO_FINE"
    assert code("cfo", "net_revenue", rules["net_revenue"], grain="hour x customer") == "GRAIN_TOO_FINE"
    d = policy.decide("cfo", "net_revenue", rules["net_revenue"], regions=["East"])
    assert d.granted and d.regions == ("East",) and "customer_email" in d.denied
    for bad in ({"customer_email": 1}, ["seen in South"], "a@b.com"):
        with pytest.raises(policy.Tripwire):
            policy.check_payload(bad, d)
    with pytest.raises(policy.AccessDenied):
        policy.row_filter(policy.Decision(False, "X"))


def test_row_filter_stands_below_the_aggregate(engine):
    plan = engine.series("net_revenue", "ops_manager")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("North")


def test_defects_and_conformance(engine):
    d = {r["defect_id"]: r for r in engine.data.defects.collect()}
    assert d["ERP-002"]["affected"] == 3 and d["ERP-003"]["affected"] == 24 and 0.01 < d["ERP-001"]["rate"] < 0.03 and d["ERP-004"]["affected"] > 0
    f = engine.data.fact
    assert f.groupBy("date", "region", "product_line").count().where("count > 1").count() == 0
    assert f.where("_quarantined and net_revenue is not null").count() == 0
    assert engine.data.marketing.where("region = 'South'").count() == 0
    e = engine.data.external
    assert e.count() == e.select("date", "product_line").distinct().count() and e.where("not observed and promo_active is not null").count() == 0


def test_planted_effect_is_recovered(engine, spark):
    """The interval of the estimate covers the counterfactual's effect on log units."""
    from kpiscope.operators.identify import Hypothesis

    w = generator.World()
    units = engine.units(Hypothesis("f", "on_time_dispatch_rate", t0=w.shock_start, treated=("North",)), w.regions, (dt.date(2026, 6, 1), w.shock_end))
    got = estimate.did(units, "y", group="product_line")
    truth = generator.cell_days(spark, w).where("hit and product_line != 'SmartHome'").agg(F.avg(F.log("units_shipped") - F.log("counterfactual_units"))).first()[0]
    assert got["low"] < truth < got["high"] and got["estimate"] < 0


def test_analysis_and_surface(engine):
    s = Service(engine)
    code, a = s.analyse("SC_SECURITY", "ops_manager")
    assert code == 200 and a["regions"] == ["North"] and a["narrative"]["mode"] in ("TEMPLATE", "DEGRADED")
    assert sum(t["value"] for t in a["decomposition"]) == pytest.approx(a["movement"]["focus"] - a["movement"]["baseline"], rel=0.2)
    assert all("low" not in h["effect"] for h in a["hypotheses"] if not h["status"].startswith("SUPPORTED"))
    assert s.analyse("NOPE", "cfo")[0] == 404 and s.series("gross_revenue", "ops_manager")[0] == 403 and s.series("nope", "cfo")[0] == 409
    code, series = s.series("on_time_dispatch_rate", "ops_manager")
    assert code == 200 and 0 <= series["points"][0][1] <= 2
    assert s.audit()[1]["denials"] >= 1 and s.data_quality("x")[0] == 403 and s.telemetry()[1]["n"] == 1
    assert s.probe("cfo", "net_revenue", {"customer_email": "x"})[0] == 403
    for f in (s.health, s.personas, s.scenarios, s.contract, s.boundary, s.index):
        assert f()[0] == 200


def test_csv_round_trip(spark, tmp_path):
    w = generator.World(end=dt.date(2026, 1, 10))
    generator.write_bundle(spark, str(tmp_path), w)
    back = files.read_bundle(spark, str(tmp_path))
    counts = {r["table"]: r["rows"] for r in files.row_counts(back).collect()}
    assert counts["erp_price_list"] == 5 and counts["ops_dispatch_events"] == 10 * 5 * 25
    assert back["ops_dispatch_events"].where("actual_hours is null").count() > 0


def test_audit_lines_are_whole_under_threads(tmp_path):
    log = policy.AuditLog(f"{tmp_path}/audit.jsonl")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: log.record(f"r{i % 5}", "cfo", "series", None, note="x" * 5000), range(200)))
    rows = [json.loads(line) for line in open(log.path, encoding="utf-8")]
    assert len(rows) == len(log.events) == 200 and len(log.by_request("r3")) == 40


def test_kpis_held_apart_are_not_compared():
    k = contract.load().kpis
    with pytest.raises(ContractViolation):
        comparable(k["net_revenue"], k["gross_revenue"])
    assert comparable(k["net_revenue"], k["units_sold"]) is None


def test_drained_stream_equals_the_batch(spark, tmp_path):
    src = f"{tmp_path}/in"
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    twice = ev.unionAll(ev.where("event_id % 3 = 0"))
    twice.orderBy("ts").repartitionByRange(3, "ts").write.parquet(src)
    got = ops_stream.drain(ops_stream.windowed(ops_stream.read_events(spark, src, 1), lateness="60 days"), f"{tmp_path}/out")
    want = ev.groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert sorted((r["window_start"].date(), r["event_type"], r["n"]) for r in got.collect()) == sorted((r["d"], r["event_type"], r["count"]) for r in want.collect())


def test_upserts_are_idempotent(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.orderBy("ts").repartitionByRange(4, "ts").write.parquet(src)
    stream = ops_stream.windowed(ops_stream.read_events(spark, src, 1), lateness="60 days")
    ops_stream.upsert(stream, out, f"{tmp_path}/cp").awaitTermination()
    assert ops_stream.read_upserts(spark, out).agg(F.sum("n")).first()[0] == ev.count()
