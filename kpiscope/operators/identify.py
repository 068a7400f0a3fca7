"""From gates, graph and estimates to a status. Status can only be lowered on the way."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.operators import estimate, gates
from kpiscope.operators.graph import Dag

INTERVENTION, DESIGN, NOT_POINT, ASSOCIATION, INSUFFICIENT = (
    "SUPPORTED_BY_INTERVENTION", "SUPPORTED_BY_DESIGN", "NOT_POINT_IDENTIFIED", "ASSOCIATION_ONLY", "INSUFFICIENT_EVIDENCE",
)
ORDER = (INSUFFICIENT, ASSOCIATION, NOT_POINT, DESIGN, INTERVENTION)


def lower(status: str, to: str) -> str:
    return min(status, to, key=ORDER.index)


@dataclass(frozen=True)
class Hypothesis:
    hypothesis_id: str
    driver: str
    outcome: str = "units_sold"
    t0: dt.date | None = None
    treated: tuple[str, ...] = ()
    designs: tuple[str, ...] = ("DID", "ITS")
    lines: tuple[str, ...] = ()
    resolution_days: float = 1.0
    prior_lag: tuple[int, int] | None = None
    no_spillover: bool = True


@dataclass
class Result:
    hypothesis_id: str
    driver: str
    status: str
    reasons: list[str] = field(default_factory=list)
    gates: dict = field(default_factory=dict)
    temporal: gates.TemporalVerdict | None = None
    strategy: dict = field(default_factory=dict)
    did: dict = field(default_factory=dict)
    its: dict = field(default_factory=dict)
    robustness: dict = field(default_factory=dict)
    assumptions: list[dict] = field(default_factory=list)
    effect: dict = field(default_factory=dict)

    @property
    def p(self) -> float | None:
        return self.effect.get("p")


def scope(h: Hypothesis, regions: Sequence[str]) -> Hypothesis:
    """The hypothesis as far as a persona may see it: foreign treated regions go."""
    kept = tuple(r for r in h.treated if r in regions)
    designs = tuple(d for d in h.designs if d != "DID" or kept)
    return Hypothesis(**{**h.__dict__, "treated": kept, "designs": designs})


def did_eligible(units: DataFrame, trends: Mapping[str, object], no_spillover: bool) -> tuple[bool, list[str]]:
    row = units.agg(
        F.count_distinct(F.when(F.col("treated"), F.col("cell"))).alias("t"), F.count_distinct(F.when(~F.col("treated"), F.col("cell"))).alias("c"),
        F.count_distinct(F.when(~F.col("post"), F.col("date"))).alias("a"), F.count_distinct(F.when(F.col("post"), F.col("date"))).alias("b"),
    ).first()
    failed = [name for ok, name in (
        (row["t"] >= 2, "TREATED_UNITS"), (row["c"] >= 2, "CONTROL_UNITS"), (row["a"] >= 8, "PRE_PERIODS"), (row["b"] >= 3, "POST_PERIODS"),
        (trends.get("status") == "COMPATIBLE", "PARALLEL_TRENDS"), (no_spillover, "SPILLOVER"),
    ) if not ok]
    return not failed, failed


def its_eligible(r: Mapping[str, object], shocks: Sequence[str]) -> tuple[bool, list[str]]:
    if r.get("status") != "OK":
        return False, ["POINTS"]
    failed = [name for ok, name in (
        (r["n_pre"] >= 20, "PRE_POINTS"), (r["n_post"] >= 5, "POST_POINTS"), (not shocks, "CONCURRENT_SHOCK"),
        (r["placebo"]["status"] == "PASS", "PLACEBO"), (r["ljung_box_p"] > 0.01, "RESIDUAL_AUTOCORRELATION"),
    ) if not ok]
    return not failed, failed


def concurrent_shocks(changepoints: Mapping[str, dt.date | None], t0: dt.date, h: Hypothesis, dag: Dag, days: int = 6) -> list[str]:
    """Other series that broke near t0, but for the outcome and the driver's own effects."""
    exempt = {h.outcome, h.driver} | (dag.descendants({h.driver}) if h.driver in dag.nodes else set())
    return sorted(k for k, d in changepoints.items() if d is not None and k not in exempt and abs((d - t0).days) <= days)


def robustness(units: DataFrame, y: str, base: Mapping[str, object], negative_control: str | None = None) -> dict[str, object]:
    """Plain day effects instead of line x day; each control cell left out; a control outcome,
    on which the randomisation test must find nothing (p over 0.10)."""
    out: dict[str, object] = {}
    b = float(base["estimate"])
    pdf = estimate.did_frame(units, y, group="product_line")
    plain, _ = estimate.did_kernel(pdf, y)
    change = abs(plain["estimate"] - b) / abs(b) if b and plain["status"] == "OK" else math.inf
    out["ALTERNATIVE_EFFECTS"] = {"pass": change < 0.30, "change": change}
    controls = sorted(set(pdf.loc[~pdf["treated"], "cell"]))
    left = [estimate.did_kernel(pdf[pdf["cell"] != c], y, group="product_line")[0] for c in controls]
    values = [r["estimate"] for r in left if r["status"] == "OK"]
    spread = (max(values) - min(values)) / abs(b) if values and b else math.inf
    out["LEAVE_ONE_OUT"] = {"pass": spread < 0.50, "range": spread}
    if negative_control and negative_control in units.columns:
        r, kernel = estimate.did_kernel(estimate.did_frame(units, negative_control, group="product_line"), negative_control, group="product_line")
        p = estimate.randomisation(units.sparkSession, *kernel)["ri_p"] if kernel is not None else None
        out["NEGATIVE_CONTROL"] = {"pass": p is None or p > 0.10, "p": p}
    return out


def series_robustness(its: Mapping[str, object]) -> dict[str, object]:
    """The checks of an interrupted series: nothing at a placebo date, and residuals that do not
    depend on each other."""
    placebo = its["placebo"]
    return {
        "PLACEBO": {"pass": placebo["status"] == "PASS", "p": placebo.get("p")},
        "RESIDUALS": {"pass": its["ljung_box_p"] > 0.01, "durbin_watson": its["durbin_watson"], "p": its["ljung_box_p"]},
    }


def assumptions(result: Result, coverage_pct: float) -> list[dict]:
    """What each design rests on, and how it stands; those of unused designs do not apply."""
    use_did, use_its = bool(result.did.get("eligible")), bool(result.its.get("eligible"))
    t = result.temporal

    def row(code: str, text: str, state: str) -> dict:
        return {"code": code, "text": text, "state": state}

    def state(ok: bool, applies: bool = True) -> str:
        return "NOT_APPLICABLE" if not applies else "SATISFIED" if ok else "VIOLATED"

    return [
        row("A1", "the driver moves before the outcome", state(bool(t and t.passed))),
        row("A1b", "the lag is within the prior range", "SATISFIED" if t and not t.prior_review else "UNKNOWN"),
        row("A2", "an adjustment set is observed", state(result.strategy.get("strategy") != "NONE")),
        row("A3", "treated and control cells moved alike before", state("PARALLEL_TRENDS" not in result.did.get("failed", []), use_did or not use_its)),
        row("A4", "no spillover onto control cells", state("SPILLOVER" not in result.did.get("failed", []), use_did or not use_its)),
        row("A5", "enough cells on both sides", state(not {"TREATED_UNITS", "CONTROL_UNITS"} & set(result.did.get("failed", [])), use_did)),
        row("A6", "no other break near the date", state("CONCURRENT_SHOCK" not in result.its.get("failed", []), use_its)),
        row("A7", "no effect at a placebo date", state("PLACEBO" not in result.its.get("failed", []), use_its)),
        row("A8", "the driver is observed", "SATISFIED" if coverage_pct > 90 else "UNKNOWN" if coverage_pct > 50 else "VIOLATED"),
    ]


def downgrade(status: str, rows: Sequence[Mapping[str, str]]) -> str:
    bad = {r["code"] for r in rows if r["state"] == "VIOLATED"}
    if "A1" in bad:
        status = lower(status, ASSOCIATION)
    if bad & {"A2", "A3", "A4", "A6", "A7"}:
        status = lower(status, NOT_POINT)
    return status


def evaluate(
    h: Hypothesis, panel: DataFrame, units: DataFrame | None, dag: Dag, observed: Sequence[str], changepoints: Mapping[str, dt.date | None],
    coverage_pct: float = 100.0, negative_control: str | None = None,
) -> Result:
    """All gates for one hypothesis. ``panel``: a stamped daily panel with the outcome, driver
    and ``is_post``; ``units``: (cell, date, product_line, y, treated, post) or none."""
    out = Result(h.hypothesis_id, h.driver, INSUFFICIENT)
    gate = gates.sufficiency(panel, h.outcome, h.driver).first()
    out.gates = gate.asDict()
    if not gate["passed"]:
        out.reasons = list(gate["failed"])
        out.effect = {"kind": "NONE"}
        return out
    white = gates.prewhiten(gates.prewhiten(panel, h.outcome, "_y"), h.driver, "_x")
    pdf = white.select("date", "_x", "_y").orderBy("date").toPandas()
    x, y = pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float)
    profile = gates.lag_correlations(x, y)
    known = np.isfinite(profile)
    lag = int(np.nanargmax(np.abs(profile))) - 14 if known.any() else None
    r = float(profile[lag + 14]) if lag is not None else None
    out.temporal = gates.temporal_verdict(lag, r, gates.lag_stability(x, y), h.resolution_days, h.prior_lag)
    out.strategy = dag.strategy(h.driver, h.outcome, observed) if h.driver in dag.nodes else {"strategy": "NONE", "set": [], "needs": []}
    if h.t0 and "DID" in h.designs and units is not None:
        trends = estimate.parallel_trends(units, "y", group="product_line")
        ok, failed = did_eligible(units, trends, h.no_spillover)
        got = estimate.did(units, "y", group="product_line")
        out.did = {"eligible": ok, "failed": failed, "trends": trends, **got}
        if ok and got["status"] == "OK":
            out.robustness = robustness(units, "y", got, negative_control)
    if h.t0 and "ITS" in h.designs:
        got = estimate.its(panel.select("date", F.col(h.outcome).alias("value"), "is_holiday", "is_promo"), h.t0)
        ok, failed = its_eligible(got, concurrent_shocks(changepoints, h.t0, h, dag))
        out.its = {"eligible": ok, "failed": failed, **got}
        if ok and not out.did.get("eligible"):
            out.robustness = series_robustness(got)
    if not out.temporal.passed:
        out.status, out.reasons = ASSOCIATION, [out.temporal.code]
    elif out.strategy["strategy"] == "NONE":
        out.status, out.reasons = NOT_POINT, ["NO_ADJUSTMENT_SET", *out.strategy["needs"]]
    elif out.did.get("eligible") or out.its.get("eligible"):
        out.status = DESIGN
    else:
        out.status, out.reasons = NOT_POINT, ["NO_DESIGN", *out.did.get("failed", []), *out.its.get("failed", [])]
    out.assumptions = assumptions(out, coverage_pct)
    out.status = downgrade(out.status, out.assumptions)
    out.effect = effect(out)
    return out


def effect(r: Result) -> dict:
    """What may be said in numbers: an interval only where a design identifies the effect."""
    if r.status in (DESIGN, INTERVENTION):
        if r.did.get("eligible"):
            return {"kind": "DID", **{k: r.did[k] for k in ("estimate", "se", "p", "low", "high", "pct", "ri_p", "cells")}}
        c = r.its["cumulative"]
        return {"kind": "ITS", "estimate": c["estimate"], "se": c["se"], "p": r.its["level"]["p"], "low": c["low"], "high": c["high"]}
    if r.temporal and r.temporal.r is not None:
        return {"kind": "ASSOCIATION", "r": r.temporal.r, "lag": r.temporal.lag}
    return {"kind": "NONE"}


def multiplicity(spark, results: Sequence[Result], q: float = 0.05) -> dict[str, object]:
    """Benjamini-Hochberg over the results that carry a p-value; supported ones that do not
    survive fall, if anything is rejected at all."""
    rows = [(r.hypothesis_id, float(r.p)) for r in results if r.p is not None and not math.isnan(r.p)]
    if not rows:
        return {"tested": 0, "candidates": len(results), "rejected": []}
    got = gates.benjamini_hochberg(spark.createDataFrame(rows, "hypothesis string, p double"), q=q).collect()
    rejected = {g["hypothesis"] for g in got if g["rejected"]}
    for r in results:
        if rejected and r.status == DESIGN and r.hypothesis_id not in rejected:
            r.status = lower(r.status, NOT_POINT)
            r.reasons.append("MULTIPLICITY")
            r.effect = effect(r)
    return {"tested": len(rows), "candidates": len(results), "rejected": sorted(rejected)}
