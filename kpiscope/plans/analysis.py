"""The flagship analysis: from a request to a checked, ranked and worded explanation."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.operators import claims, conform, decision, decompose, evidence, identify, metrics, movement, panel, quality, structure
from kpiscope.operators.metrics import FLOW, ContractViolation
from kpiscope.plans.contract import Contract, load
from kpiscope.plans.policy import PERSONAS, AccessDenied, AuditLog, Decision, Tripwire, check_payload, decide, scoped
from kpiscope.plans.telemetry import Telemetry
from kpiscope.sources import loaders

#: The periods compared.
FOCUS = (dt.date(2026, 8, 1), dt.date(2026, 8, 25))
BASELINE = (dt.date(2026, 6, 1), dt.date(2026, 7, 24))


@dataclass
class Conformed:
    fact: DataFrame
    ops_wh: DataFrame
    ops_region: DataFrame
    marketing: DataFrame
    external: DataFrame
    defects: DataFrame
    freshness: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"fact_daily": self.fact, "ops_wh_daily": self.ops_wh, "ops_region_daily": self.ops_region, "mkt_region_daily": self.marketing, "ext_line_daily": self.external}


def conform_bundle(bundle: Mapping[str, DataFrame], start: dt.date, end: dt.date, freshness: DataFrame | None = None, cache: bool = True) -> Conformed:
    """Load rules and conformance over a bundle of raw tables; results are kept in memory, as
    every later step reads them (aggregates of a day's grain)."""
    spark = bundle["erp_orders_daily"].sparkSession
    orders, refunds = loaders.orders(bundle["erp_orders_daily"]), loaders.refunds(bundle["erp_refunds_daily"])
    wh = conform.warehouse_daily(loaders.dispatch(bundle["ops_dispatch_events"]))
    tickets = loaders.tickets(bundle["ops_support_tickets_daily"], end)
    lines = bundle["erp_orders_daily"].select("product_line")
    got = Conformed(
        conform.fact_daily(orders, refunds), wh, conform.region_daily(wh, tickets, orders),
        conform.allocate_weeks(loaders.marketing(bundle["mkt_campaign_weekly"]).withColumnRenamed("spend_inr", "marketing_spend"), "marketing_spend", end),
        conform.densify(loaders.external(bundle["ext_competitor_promo"]), lines, start, end), loaders.order_defects(bundle["erp_orders_daily"]),
        freshness if freshness is not None else spark.createDataFrame([], "source string, status string"),
    )
    if cache:
        for name, df in got.tables().items():
            attr = {"fact_daily": "fact", "ops_wh_daily": "ops_wh", "ops_region_daily": "ops_region", "mkt_region_daily": "marketing", "ext_line_daily": "external"}[name]
            setattr(got, attr, df.cache())
    return got


def source_freshness(manifest: DataFrame) -> DataFrame:
    """(source, age_hours, status) from a manifest: refresh times without an offset are local;
    a source that was never refreshed is missing."""
    age = quality.refresh_age_hours(F.col("last_refresh_at"), F.col("as_of").cast("timestamp"))
    status = F.when(F.col("last_refresh_at").isNull(), "MISSING").otherwise(quality.freshness(age, F.col("cadence_hours")))
    return manifest.select("source", age.alias("age_hours"), status.alias("status"))


@dataclass(frozen=True)
class Scenario:
    scenario_id: str
    kpi: str
    hypotheses: tuple[identify.Hypothesis, ...]
    focus: tuple[dt.date, dt.date] = FOCUS
    baseline: tuple[dt.date, dt.date] = BASELINE
    launch: dt.date | None = None


#: Scenario ids, windows and dates.
_T0 = dt.date(2026, 7, 31)
LAUNCH = dt.date(2026, 8, 7)
#: The KPIs that an analysis looks at beside its own.
CONNECTED = ("units_sold", "avg_selling_price", "on_time_dispatch_rate", "complaint_rate", "subscription_arr")
_FULFIL = identify.Hypothesis("fulfilment", "on_time_dispatch_rate", t0=_T0, treated=("North",), prior_lag=(2, 5))
_RIVAL = identify.Hypothesis("competitor", "competitor_promo", designs=(), prior_lag=(0, 3))
_MKT = identify.Hypothesis("marketing", "marketing_spend", designs=(), resolution_days=7.0, prior_lag=(3, 10))
SCENARIOS: Mapping[str, Scenario] = {
    s.scenario_id: s
    for s in (
        Scenario("SC_MULTIFACTOR", "net_revenue", (_FULFIL, _RIVAL, _MKT, identify.Hypothesis("price", "avg_selling_price", designs=()), identify.Hypothesis("complaints", "complaint_rate", designs=()))),
        Scenario("SC_LOWCONF", "net_revenue", (_MKT, _RIVAL, _FULFIL), (dt.date(2026, 8, 7), dt.date(2026, 8, 25)), (dt.date(2026, 6, 15), dt.date(2026, 8, 6))),
        Scenario("SC_SPARSE", "subscription_arr", (_MKT,), (dt.date(2026, 8, 12), dt.date(2026, 8, 25)), (dt.date(2026, 8, 5), dt.date(2026, 8, 11)), launch=LAUNCH),
        Scenario("SC_SECURITY", "net_revenue", (_FULFIL,)),
    )
}


def side_by_side(f: Callable, items: Sequence) -> list:
    """``f`` of each item, in order; the items' small Spark jobs run at a time."""
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(f, items))


class UnknownScenario(KeyError):
    pass


@dataclass
class Engine:
    """One engine for a bundle; analyses share its conformed tables, audit log and contract."""

    spark: SparkSession
    data: Conformed
    start: dt.date
    end: dt.date
    contract: Contract = field(default_factory=load)
    audit: AuditLog = field(default_factory=AuditLog)
    permutations: int = 800
    drafter: Callable[[dict[str, str]], dict[str, str]] | None = None
    history: list[dict] = field(default_factory=list)

    # -- data ------------------------------------------------------------------------------

    def source_of(self, kpi_id: str) -> DataFrame:
        return {"on_time_dispatch_rate": self.data.ops_wh, "complaint_rate": self.data.ops_region}.get(kpi_id, self.data.fact)

    def series(self, kpi_id: str, persona: str, grain: str | None = None, regions: Sequence[str] | None = None) -> DataFrame:
        """The KPI at a permitted grain; refused before any plan is built if not granted."""
        d = self.decide("series", kpi_id, persona, grain, regions)
        k = self.contract.kpi(kpi_id)
        src = scoped(self.source_of(kpi_id), d)
        if d.warehouses and "warehouse" in src.columns:
            src = src.where(F.col("warehouse").isin(*d.warehouses))
        sound = ~F.col("_quarantined") if "_quarantined" in src.columns else F.lit(True)
        dims = [c for c in d.dims if c in src.columns]
        if d.grain.startswith("fiscal_period"):
            return metrics.fiscal_rollup(src, k, dims, row_filter=sound)
        return metrics.kpi_series(src, k, dims, row_filter=sound)

    def points(self, kpi_id: str, persona: str) -> DataFrame:
        return metrics.points(self.series(kpi_id, persona))

    def decide(self, action: str, kpi_id: str, persona: str, grain: str | None = None, regions: Sequence[str] | None = None) -> Decision:
        self.contract.kpi(kpi_id)
        d = decide(persona, kpi_id, self.contract.rules[kpi_id], grain, regions)
        self.audit.record(uuid.uuid4().hex[:8], persona, action, d, kpi=kpi_id)
        if not d.granted:
            raise AccessDenied(f"{d.code}: {d.reason}")
        return d

    def panel(self, regions: Sequence[str]) -> DataFrame:
        """One row a day with every node of the graph, over the given regions."""
        r = F.col("region").isin(*regions)
        fact = self.data.fact.where(r & ~F.col("_quarantined")).groupBy("date").agg(F.sum("net_revenue").alias("net_revenue"), F.sum("units_sold").alias("units_sold"))
        fact = fact.withColumn("avg_selling_price", F.try_divide("net_revenue", "units_sold"))
        ops = self.data.ops_region.where(r).groupBy("date").agg(*[F.sum(c).alias(c) for c in ("dispatched_within_sla", "dispatch_attempts", "complaint_tickets", "shipped_orders")])
        ops = ops.select("date", F.try_divide("dispatched_within_sla", "dispatch_attempts").alias("on_time_dispatch_rate"), (1000 * F.try_divide("complaint_tickets", "shipped_orders")).alias("complaint_rate"))
        mkt = self.data.marketing.where(r).groupBy("date").agg(F.sum("marketing_spend").alias("marketing_spend"))
        ext = panel.observed_mean(self.data.external.withColumnRenamed("promo_active", "competitor_promo"), "competitor_promo")
        arr = self.data.fact.where(r & ~F.col("_quarantined")).groupBy("date").agg((12 * F.sum("monthly_subscription_revenue")).alias("subscription_arr"))
        got = panel.calendar_panel(self.spark, self.start, self.end, {"a": fact, "b": ops, "c": mkt, "d": ext, "e": panel.unknown_before(arr, "subscription_arr", LAUNCH)})
        return panel.seasonal_index(got, "units_sold").withColumn("promo_calendar", F.col("is_promo").cast("double"))

    def units(self, h: identify.Hypothesis, regions: Sequence[str], window: tuple[dt.date, dt.date]) -> DataFrame | None:
        if not h.treated or h.t0 is None:
            return None
        f = self.data.fact.where(F.col("region").isin(*regions) & ~F.col("_quarantined") & F.col("date").between(*map(F.lit, window)))
        full = f.groupBy("region", "product_line").agg(F.min("date").alias("_first")).where(F.col("_first") <= F.lit(window[0] + dt.timedelta(days=7)))
        got = panel.unit_panel(f.join(F.broadcast(full), ["region", "product_line"]), ("region", "product_line"), ("units_sold", "list_price"))
        return got.withColumns({"y": F.log(F.greatest("units_sold", F.lit(1.0))), "treated": F.col("region").isin(*h.treated), "post": F.col("date") >= F.lit(h.t0)})

    # -- analysis --------------------------------------------------------------------------

    def analyse(self, scenario_id: str, persona: str, grain: str | None = None, regions: Sequence[str] | None = None) -> dict:
        if scenario_id not in SCENARIOS:
            raise UnknownScenario(scenario_id)
        sc, tel = SCENARIOS[scenario_id], Telemetry()
        kpi = self.contract.kpi(sc.kpi)
        with tel.span("access"):
            d = self.decide("analyse", sc.kpi, persona, grain, regions)
            for h in sc.hypotheses:
                if h.driver in self.contract.kpis:
                    metrics.comparable(kpi, self.contract.kpi(h.driver))
        with tel.span("movement"):
            daily = metrics.kpi_series(self.scoped_fact(d), kpi).select("date", "value").cache()
            value = metrics.window_value(metrics.kpi_series(self.scoped_fact(d), kpi), kpi, *sc.focus).first()["value"]
            move = movement.detect(daily, sc.baseline, sc.focus, kpi.time_aggregation == FLOW, value, self.permutations)
        with tel.span("connected"):
            connected = self.connected(d, sc, persona)
        with tel.span("decomposition"):
            terms = self.decomposition(d, kpi, sc)
        with tel.span("hypotheses"):
            p = self.panel(d.regions).withColumn("is_post", F.col("date") >= F.lit(sc.focus[0])).where(F.col("date").between(F.lit(sc.baseline[0]), F.lit(sc.focus[1]))).coalesce(1).cache()  # a row a day
            cover = {r["variable"]: r["pct"] for r in panel.coverage(p, [h.driver for h in sc.hypotheses]).collect()}
            observed = [c for c in p.columns if c in self.contract.dag.nodes]
            p.count()
            breaks = {k: v.split_date for k, v in connected.items()}

            def judge(h: identify.Hypothesis) -> identify.Result:
                scope = identify.scope(h, d.regions)
                u = self.units(scope, d.regions, (sc.baseline[0], sc.focus[1]))
                u = u.coalesce(1).cache() if u is not None else None  # a row a cell and day
                return identify.evaluate(scope, p, u, self.contract.dag, observed, breaks, cover.get(h.driver, 0.0), "list_price")

            results = side_by_side(judge, sc.hypotheses)
            family = identify.multiplicity(self.spark, results)
        with tel.span("evidence"):
            found = self.evidence(kpi, move, terms, results, cover, sc, d).cache()
            facts = [r.asDict() for r in found.collect()]
            def cite(h: identify.Hypothesis) -> list[str]:
                return [r["evidence_id"] for r in decision.retrieve(found, h.hypothesis_id).orderBy("evidence_id").collect()]

            def screened(_: None) -> dict:
                return {(r["source"], r["target"]): r["verdict"] for r in structure.screen(p, self.contract.dag).collect()}

            def stake(x: tuple) -> float:
                return self.exposure(*x, d, sc, terms)

            tasks = [(cite, h) for h in sc.hypotheses] + [(screened, None)] + [(stake, x) for x in zip(results, sc.hypotheses)]
            got = side_by_side(lambda t: t[0](t[1]), tasks)
            k = len(sc.hypotheses)
            cited, edges, stakes = {h.hypothesis_id: c for h, c in zip(sc.hypotheses, got)}, got[k], got[k + 1 :]
            hyp = self.assess(results, facts, kpi, move, cover, edges, {h.hypothesis_id: s for h, s in zip(sc.hypotheses, stakes)})
        with tel.span("actions"):
            frame = self.spark.createDataFrame([(h["hypothesis_id"], h["driver"], h["status"], h["action"]) for h in hyp], "hypothesis string, driver string, status string, action string")
            recs = [r.asDict() for r in decision.recommend(frame, decision.playbooks(self.spark), persona).select("rank", "hypothesis", "playbook_id", "score", "conflicts_with").orderBy("rank").collect()]
        gaps = [f"Little is known of {k.replace('_', ' ')}." for k, v in sorted(cover.items()) if v < 50]
        out = {
            "request_id": uuid.uuid4().hex[:12], "scenario": scenario_id, "persona": persona, "kpi": sc.kpi, "grain": d.grain, "regions": list(d.regions),
            "value": value, "movement": asdict(move), "alert": move.pct is not None and _crosses(move.pct, kpi), "connected": {k: asdict(v) for k, v in connected.items()},
            "decomposition": terms, "hypotheses": hyp, "multiplicity": family, "evidence": facts, "n_evidence": len(facts), "cited": cited, "recommendations": recs, "gaps": gaps, "lineage": self.contract.lineage_card(sc.kpi),
            "run": {"contract": self.contract.digest, "transforms": [t.transform_id for t in conform.TRANSFORMS], "row_filter": list(d.regions), "focus": [str(x) for x in sc.focus], "baseline": [str(x) for x in sc.baseline], "permutations": self.permutations},
        }
        out["abstention"] = claims.abstain([h["status"] for h in hyp])
        out["clarification"] = self.clarify(out, sc, results)
        out["benchmark"] = self.benchmark(sc, d) if sc.launch else None
        with tel.span("text", "TEXT"):
            status = {h["driver"]: h["status"] for h in hyp}
            sections = claims.fit_words(claims.plan(out, persona), claims.PROFILES[persona].sections, PERSONAS[persona].max_words)
            foreign = set(PERSONAS["cfo"].regions) - set(d.regions)
            contract = claims.build(out, status, d.regions, foreign, claims.PROFILES[persona].sections, (), PERSONAS[persona].max_words)
            try:
                check_payload(sections, d)  # nothing that the persona may not see reaches a drafter
                if kinds := claims.type_faults(claims.statements(out, persona), status):
                    raise Tripwire(f"claims of a type that their status forbids: {kinds}")
                out["narrative"] = claims.render(sections, contract, self.drafter) | {"contract": contract.digest}
            except Tripwire as e:
                out["narrative"] = {"mode": "DEGRADED", "sections": {s: "This section was withheld." for s in contract.required}, "calls": 0, "faults": [("Y5", str(e))], "contract": contract.digest}
        out["telemetry"] = tel.report()
        self.history.append({"scenario": scenario_id, "persona": persona, "ms": tel.total_ms()})
        return out

    def scoped_fact(self, d: Decision) -> DataFrame:
        return self.data.fact.where(F.col("region").isin(*d.regions) & ~F.col("_quarantined"))

    def connected(self, d: Decision, sc: Scenario, persona: str) -> dict[str, movement.Movement]:
        """Movements of the KPIs beside the analysis's own that the persona may see, over the
        granted regions, each with its own seed."""
        names = [n for n in CONNECTED if n != sc.kpi and decide(persona, n, self.contract.rules[n]).granted]

        def move(name: str) -> movement.Movement:
            kpi, src = self.contract.kpi(name), self.source_of(name)
            src = src.where(F.col("region").isin(*d.regions))
            if d.warehouses and "warehouse" in src.columns:
                src = src.where(F.col("warehouse").isin(*d.warehouses))
            if "_quarantined" in src.columns:
                src = src.where(~F.col("_quarantined"))
            s = metrics.kpi_series(src, kpi)
            if name == "subscription_arr":
                s = s.where(F.col("date") >= F.lit(LAUNCH))
            value = metrics.window_value(s, kpi, *sc.focus).first()["value"]
            return movement.detect(s.select("date", "value"), sc.baseline, sc.focus, kpi.time_aggregation == FLOW, value, min(250, self.permutations), seed=sum(map(ord, name)))

        return dict(zip(names, side_by_side(move, names)))

    def decomposition(self, d: Decision, kpi: metrics.Kpi, sc: Scenario) -> list[dict]:
        try:
            row = decompose.decompose(self.scoped_fact(d), kpi, ["region", "product_line"], F.col(kpi.kpi_id) if kpi.kpi_id in self.data.fact.columns else F.lit(None).cast("double"), F.col("units_sold"), sc.baseline, sc.focus).first()
        except ContractViolation:
            return []
        return [{"term": t, "value": row[t], "pp": row[f"{t}_pp"], "share": row[f"{t}_share"]} for t in decompose.TERMS]

    def evidence(self, kpi, move, terms, results, cover, sc, d: Decision) -> DataFrame:
        parts = []
        if move.pct is not None:
            parts.append(evidence.movement(self.spark.createDataFrame([(kpi.kpi_id, float(move.pct), 60)], "kpi string, pct double, n int")))
        if terms:
            parts.append(evidence.decomposition(self.spark.createDataFrame([(t["term"], float(t["pp"] or 0)) for t in terms], "term string, pp double")))
        found = [(r.hypothesis_id, r.effect["kind"], float(r.effect["estimate"]), float(r.effect["p"])) for r in results if "estimate" in r.effect]
        if found:
            parts.append(evidence.causal(self.spark.createDataFrame(found, "hypothesis string, design string, estimate double, p double")))
        rows = [(k, float(v), "COMPLETE" if v > 99 else "PARTIAL" if v >= 50 else "SPARSE" if v > 0 else "ABSENT") for k, v in cover.items()]
        parts.append(evidence.gaps(self.data.freshness, self.spark.createDataFrame(rows, "variable string, pct double, status string"), self.data.defects))
        treated = next((h.treated[0] for h in sc.hypotheses if h.treated), None)
        if treated:
            mine = self.data.ops_region.where(F.col("region").isin(*d.regions))  # no reading of a place out of scope
            parts.append(evidence.operational(mine, sc.baseline, sc.focus, treated))
        return evidence.union(parts)

    def assess(self, results, facts, kpi, move, cover, edges, stakes: Mapping[str, float]) -> list[dict]:
        rows = []
        for r in results:
            mine = [e for e in facts if r.hypothesis_id in e["hypotheses"] and e["stance"] == "SUPPORT"]
            gaps = sum(e["stance"] == "GAP" for e in facts)
            failures = sum(not v["pass"] for v in r.robustness.values())
            rows.append((r.hypothesis_id, float(max([e["weight"] for e in mine], default=0.0)), bool(r.temporal and r.temporal.passed), float(r.temporal.r) if r.temporal and r.temporal.r is not None else None, r.status,
                         len({e["source"] for e in mine}), edges.get((r.driver, "units_sold"), "NOT_TESTABLE"), cover.get(r.driver, 0.0) / 100, gaps, float(r.p) if r.p is not None else None, failures, float(stakes[r.hypothesis_id])))
        f = self.spark.createDataFrame(rows, "hypothesis string, ev double, passed boolean, r double, status string, n int, structure string, complete double, gaps int, p double, failures int, exposure double")
        parts = decision.attention(*[F.col(c) for c in ("ev", "passed", "r", "status", "n", "structure", "complete", "gaps")])
        ratio = decision.impact_ratio(F.col("exposure"), F.lit(abs(move.pct or 0.0)), F.lit(float(kpi.materiality_abs)), F.lit(float(kpi.materiality_pct)))
        f = f.withColumns(parts).withColumns({"statistical_tier": decision.statistical_tier(F.col("status"), F.col("p"), F.col("failures")), "impact_tier": decision.impact_tier(ratio)})
        got = {g["hypothesis"]: g.asDict() for g in decision.prioritise(decision.rank(f)).collect()}
        out = []
        for r in results:
            g = got[r.hypothesis_id]
            out.append({"hypothesis_id": r.hypothesis_id, "driver": r.driver, "status": r.status, "reasons": r.reasons, "effect": r.effect, "strategy": r.strategy, "temporal": asdict(r.temporal) if r.temporal else None, "assumptions": r.assumptions, "robustness": r.robustness,
                        "attention": {k: g[k] for k in (*decision.ATTENTION_WEIGHTS, "score")}, "rank": g["rank"], "statistical_tier": g["statistical_tier"], "impact_tier": g["impact_tier"], "priority": g["priority"], "action": g["action"], "exposure_per_day": g["exposure"]})
        return sorted(out, key=lambda h: h["rank"])

    def exposure(self, r: identify.Result, h: identify.Hypothesis, d: Decision, sc: Scenario, terms: Sequence[dict]) -> float:
        """Value a day at stake. An identified effect in units (the estimate is of logarithms): the
        treated cells' units times the price before. A price hypothesis: the decomposition's price
        term. All others: the change of the segment's revenue a day, which is no effect."""
        regions = [x for x in h.treated if x in d.regions] or list(d.regions)
        seg = F.col("region").isin(*regions)
        fact = self.scoped_fact(d)
        if r.effect.get("kind") == "DID":
            row = fact.where(seg & F.col("date").between(*map(F.lit, sc.baseline))).agg(
                F.sum("units_sold").alias("q"), F.count_distinct("date").alias("days"), F.count_distinct("region", "product_line").alias("cells")
            ).first()
            cells = row["cells"] or 1
            per_cell = float(row["q"] or 0.0) / max(1, row["days"]) / cells
            price = metrics.baseline_price(fact, seg, *sc.baseline).first()["price"]
            return metrics.exposure("DID", effect=math.expm1(r.effect["estimate"]) * per_cell, cells=cells, price=price)
        term = next((t["value"] for t in terms if t["term"] == "price"), None)
        if h.driver == "avg_selling_price" and term is not None:
            return metrics.exposure("TERM", term=term)
        before, after = (metrics.segment_revenue_per_day(fact, seg, *w).first()["per_day"] for w in (sc.baseline, sc.focus))
        return metrics.exposure("DELTA", before=before, after=after)

    def clarify(self, out: dict, sc: Scenario, results: Sequence[identify.Result]) -> dict | None:
        found: dict[str, str] = {}
        if out["gaps"]:
            found["COVERAGE_GAP"] = out["gaps"][0].removeprefix("Little is known of ").rstrip(".")
        for r in results:
            if r.temporal and r.temporal.code == "GRAIN_TOO_COARSE":
                found["COARSE_GRAIN"] = r.driver.replace("_", " ")
            for need in r.strategy.get("needs", []):
                found["CONFOUNDER"] = need.replace("_", " ")
        if sc.launch:
            found["SPARSE_HISTORY"] = (sc.launch + dt.timedelta(days=20)).isoformat()
        return claims.clarification(found)

    def benchmark(self, sc: Scenario, d: Decision, mature: str = "Home") -> dict | None:
        """A new line's revenue a day against a mature line's over the same dates, and the first and
        last stock value. Where the grant has no lines, the lines stay unnamed."""
        fact = self.scoped_fact(d)
        lines = fact.groupBy("product_line").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("days"), F.sum("net_revenue").alias("total"))
        new = lines.where(F.col("first") >= F.lit(sc.launch)).orderBy("first", "product_line").first()
        if new is None:
            return None
        same = F.col("product_line") == mature
        beside = metrics.segment_revenue_per_day(fact, same, new["first"], new["last"]).first()["per_day"]
        kpi = self.contract.kpi(sc.kpi)
        ends = None
        if kpi.time_aggregation == metrics.STOCK:
            stock = metrics.kpi_series(fact, kpi, ()).where("value > 0")
            ends = metrics.last_stock(stock, "value", "date").first()
        per_day = new["total"] / new["days"]
        named = "product_line" in d.dims
        line, other = (new["product_line"], mature) if named else ("The new line", "a mature line")
        return {
            "line": line, "beside": other, "named": named, "days": new["days"], "per_day": per_day, "beside_per_day": beside,
            "ratio": per_day / beside if beside else None, "first_value": ends and ends["first_value"], "last_value": ends and ends["last_value"],
            "text": f"{line} has too short a history; it is set beside {other} over the same dates, for reference and not as a counterfactual.",
        }

    def intervention(self, persona: str, h: identify.Hypothesis, implemented: dt.date) -> dict:
        """Re-estimate after a measure: promoted if the effect is positive and clear."""
        d = self.decide("intervention", "units_sold", persona)
        after = identify.Hypothesis(**{**h.__dict__, "t0": implemented + dt.timedelta(days=1)})
        from kpiscope.operators import estimate

        r = estimate.did(self.units(after, d.regions, (FOCUS[0], self.end)), "y", group="product_line")
        good = r["status"] == "OK" and r["estimate"] > 0 and r["ri_p"] < 0.10
        return {**r, "status_after": identify.INTERVENTION if good else identify.NOT_POINT}


def _crosses(pct: float, kpi: metrics.Kpi) -> bool:
    return {"up": pct >= kpi.alert_pct, "down": pct <= -kpi.alert_pct, "both": abs(pct) >= kpi.alert_pct}[kpi.alert_direction]
