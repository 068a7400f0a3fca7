"""Access decisions before any plan is built, and their effect on a table."""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.sources.files import append_jsonl

#: Grains from coarse to fine; an unknown grain is finer than all.
GRAIN_ORDER = {"fiscal_period x region": 1, "day x region": 2, "day x warehouse": 3, "day x region x category": 3, "day x region x product_line": 4}
UNKNOWN_GRAIN = 99
GRAIN_DIMS = {"fiscal_period x region": ("region",), "day x region": ("region",), "day x warehouse": ("warehouse",), "day x region x category": ("region",), "day x region x product_line": ("region", "product_line")}


class AccessDenied(PermissionError):
    """A request that was not granted reached the data plane."""


@dataclass(frozen=True)
class Persona:
    persona_id: str
    role: str
    regions: tuple[str, ...]
    warehouses: tuple[str, ...] = ()
    kpis: tuple[str, ...] = ()
    denied_fields: tuple[str, ...] = ()
    max_words: int = 200


#: The KPIs, regions, private fields and limits of each persona.
_ALL = ("net_revenue", "gross_revenue", "recognized_revenue_finance", "units_sold", "avg_selling_price", "on_time_dispatch_rate", "complaint_rate", "subscription_arr")
_REGIONS = ("North", "South", "East", "West")
_PRIVATE = ("customer_id", "customer_email", "employee_id", "shift_id", "staff_productivity_score", "ticket_body")
PERSONAS: Mapping[str, Persona] = {
    p.persona_id: p
    for p in (
        Persona("cfo", "cfo", _REGIONS, (), _ALL, _PRIVATE, 190),
        Persona("ops_manager", "ops_manager", ("North",), ("WH-N1", "WH-N2"), ("units_sold", "avg_selling_price", "on_time_dispatch_rate", "complaint_rate", "net_revenue"), ("gross_margin_pct", "refund_liability_inr", "discount_policy_note", "customer_id", "customer_email", "deferred_delta"), 260),
        Persona("finance_analyst", "finance_analyst", _REGIONS, (), _ALL, _PRIVATE, 380),
    )
}


@dataclass(frozen=True)
class Rule:
    """A KPI's rule for a role."""

    max_grain: str
    denied_fields: tuple[str, ...] = ()
    allowed: bool = True


@dataclass(frozen=True)
class Decision:
    granted: bool
    code: str
    reason: str = ""
    regions: tuple[str, ...] = ()
    warehouses: tuple[str, ...] = ()
    dims: tuple[str, ...] = ()
    denied: tuple[str, ...] = ()
    grain: str = ""
    trail: tuple[str, ...] = field(default=())


def decide(persona_id: str, kpi: str, rules: Mapping[str, Rule], grain: str | None = None, regions: Sequence[str] | None = None, personas: Mapping[str, Persona] = PERSONAS) -> Decision:
    """Persona, KPI domain, contract rule, rows, grain, columns, in this order; closed by
    default. Requested regions narrow the scope; any outside it refuses the whole request."""
    who = personas.get(persona_id)
    if who is None:
        return Decision(False, "UNKNOWN_PERSONA", f"no persona {persona_id!r}")
    if kpi not in who.kpis:
        return Decision(False, "KPI_OUT_OF_DOMAIN", f"{persona_id} may not see {kpi}")
    rule = rules.get(who.role)
    if rule is None or not rule.allowed:
        return Decision(False, "NO_CONTRACT_RULE", f"the contract grants {who.role} nothing on {kpi}")
    asked = tuple(regions) if regions else who.regions
    if outside := [r for r in asked if r not in who.regions]:
        return Decision(False, "ROW_SCOPE", f"regions {outside} are out of scope")
    want = grain or rule.max_grain
    if GRAIN_ORDER.get(want, UNKNOWN_GRAIN) > GRAIN_ORDER.get(rule.max_grain, 0):
        return Decision(False, "GRAIN_TOO_FINE", f"{want} is finer than {rule.max_grain}")
    denied = tuple(sorted({*who.denied_fields, *rule.denied_fields}))
    return Decision(True, "OK", "", asked, who.warehouses, GRAIN_DIMS[want], denied, want, ("persona", "domain", "rule", "rows", "grain", "columns"))


def row_filter(decision: Decision, column: str = "region") -> Column:
    if not decision.granted:
        raise AccessDenied(decision.code)
    return F.col(column).isin(*decision.regions)


def scoped(df: DataFrame, decision: Decision, column: str = "region") -> DataFrame:
    """Rows and columns a decision grants; the filter stands below every later aggregation."""
    got = df.where(row_filter(decision, column))
    return got.drop(*[c for c in decision.denied if c in got.columns])


class Tripwire(AccessDenied):
    """Text for a model or a reader holds what the persona may not see."""


def check_payload(payload: object, decision: Decision, all_regions: Sequence[str] = _REGIONS, path: str = "$") -> None:
    """Walk a payload; a denied key, a foreign region or an e-mail address raises."""
    if isinstance(payload, Mapping):
        for k, v in payload.items():
            if k in decision.denied:
                raise Tripwire(f"{path}.{k} is denied")
            check_payload(v, decision, all_regions, f"{path}.{k}")
    elif isinstance(payload, (list, tuple, set)):
        for i, v in enumerate(payload):
            check_payload(v, decision, all_regions, f"{path}[{i}]")
    elif isinstance(payload, str):
        for r in all_regions:
            if r not in decision.regions and r in payload.replace(",", " ").replace(".", " ").split():
                raise Tripwire(f"{path} names {r}")
        if "@" in payload and "." in payload.split("@", 1)[1]:
            raise Tripwire(f"{path} holds an address")


class AuditLog:
    """Append-only events, kept in memory and, if a path is given, as JSON lines."""

    def __init__(self, path: str | None = None) -> None:
        self.path, self.events, self.lock = path, [], threading.Lock()

    def record(self, request_id: str, persona: str, action: str, decision: Decision | None = None, **detail: object) -> dict:
        event = {"request_id": request_id, "persona": persona, "action": action, "granted": decision.granted if decision else None, "code": decision.code if decision else None, **detail}
        with self.lock:
            self.events.append(event)
            if self.path:
                append_jsonl(self.path, event)
        return event

    def by_request(self, request_id: str) -> list[dict]:
        return [e for e in self.events if e["request_id"] == request_id]

    def denials(self) -> list[dict]:
        return [e for e in self.events if e["granted"] is False]

    def tail(self, n: int = 50) -> list[dict]:
        return self.events[-n:]
