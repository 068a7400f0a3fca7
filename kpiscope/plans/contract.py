"""The semantic contract: read from YAML, validated as a whole, then fixed."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

import yaml

from kpiscope.functions.formula import names
from kpiscope.operators.graph import Dag
from kpiscope.operators.metrics import FLOW, RATIO, STOCK, ContractViolation, Kpi
from kpiscope.plans.policy import GRAIN_ORDER, Rule

DEFAULT = Path(__file__).with_name("contract.yaml")


@dataclass(frozen=True)
class Contract:
    version: str
    digest: str
    sources: tuple[str, ...]
    calendars: Mapping[str, Mapping[str, object]]
    kpis: Mapping[str, Kpi]
    rules: Mapping[str, Mapping[str, Rule]]
    dag: Dag
    raw: Mapping[str, object]

    def kpi(self, kpi_id: str) -> Kpi:
        if kpi_id not in self.kpis:
            raise ContractViolation(f"no KPI {kpi_id!r}")
        return self.kpis[kpi_id]

    def lineage_card(self, kpi_id: str) -> dict[str, object]:
        k, spec = self.kpi(kpi_id), self.raw["kpis"][kpi_id]
        return {"kpi": kpi_id, "formula": k.formula, "columns": k.columns, "sources": spec["sources"], "calendar": spec["calendar"], "grain": spec["grain"], "time_aggregation": k.time_aggregation, "contract_version": self.version, "contract_hash": self.digest}


def load(path: str | Path = DEFAULT) -> Contract:
    text = Path(path).read_text(encoding="utf-8")
    return build(yaml.safe_load(text), hashlib.sha256(text.encode()).hexdigest()[:16])


def build(spec: Mapping, digest: str = "") -> Contract:
    """Every fault is collected, so that one run shows all of them."""
    faults: list[str] = []
    sources, calendars, specs = tuple(spec["sources"]), dict(spec["calendars"]), dict(spec["kpis"])
    kpis, rules = {}, {}
    for kpi_id, s in specs.items():
        apart = tuple(s.get("not_interchangeable_with", ()))
        if unknown := set(s["sources"]) - set(sources):
            faults.append(f"{kpi_id}: unknown sources {sorted(unknown)}")
        if s["calendar"] not in calendars:
            faults.append(f"{kpi_id}: unknown calendar {s['calendar']}")
        if s["time_aggregation"] not in (FLOW, STOCK, RATIO):
            faults.append(f"{kpi_id}: time aggregation {s['time_aggregation']!r}")
        if s.get("additive") and s["time_aggregation"] != FLOW:
            faults.append(f"{kpi_id}: only flows are additive")
        for other in apart:
            if kpi_id not in specs.get(other, {}).get("not_interchangeable_with", ()):
                faults.append(f"{kpi_id}: not interchangeable with {other}, but not the other way round")
        if s["grain"] not in GRAIN_ORDER:
            faults.append(f"{kpi_id}: unknown grain {s['grain']!r}")
        try:
            names(s["formula"])
        except ValueError as e:
            faults.append(f"{kpi_id}: {e}")
        rules[kpi_id] = {role: Rule(r["max_grain"], tuple(r.get("denied_fields", ())), r.get("allowed", True)) for role, r in s.get("access", {}).items()}
        m = s["materiality"]
        kpis[kpi_id] = Kpi(kpi_id, s["formula"], s["time_aggregation"], float(s.get("scale", 1)), tuple(s["grain"].split(" x ")), s["alert"]["pct"], s["alert"]["direction"], m["absolute"], m["pct"], m["multiplier"], apart)
    dag = Dag.of([tuple(e) for e in spec["graph"]["edges"]], spec["graph"]["unobserved"])
    if faults:
        raise ContractViolation("; ".join(faults))
    return Contract(str(spec["version"]), digest, sources, calendars, kpis, rules, dag, spec)
