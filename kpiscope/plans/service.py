"""The engine's surface as plain functions: each returns a status code and a JSON-ready body."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from kpiscope.functions.formula import FormulaError
from kpiscope.operators.metrics import ContractViolation
from kpiscope.plans.analysis import SCENARIOS, Engine, UnknownScenario
from kpiscope.plans.policy import PERSONAS, AccessDenied, check_payload, decide

Response = tuple[int, dict]


def guarded(f: Callable[..., dict]) -> Callable[..., Response]:
    """Denied requests are 403, contract faults 409, unknown names 404."""
    def run(*args: object, **options: object) -> Response:
        try:
            return 200, f(*args, **options)
        except AccessDenied as e:
            return 403, {"error": str(e)}
        except (ContractViolation, FormulaError) as e:
            return 409, {"error": str(e)}
        except UnknownScenario as e:
            return 404, {"error": f"no scenario {e}"}

    return run


class Service:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine
        self.analyse = guarded(engine.analyse)
        self.series = guarded(self._series)
        self.intervention = guarded(engine.intervention)
        self.data_quality = guarded(self._quality)
        self.probe = guarded(self._probe)

    def health(self) -> Response:
        return 200, {"status": "ok", "contract": self.engine.contract.digest, "spark": self.engine.spark.version}

    def personas(self) -> Response:
        return 200, {p.persona_id: {"regions": list(p.regions), "kpis": list(p.kpis)} for p in PERSONAS.values()}

    def scenarios(self) -> Response:
        return 200, {s.scenario_id: {"kpi": s.kpi, "focus": [str(d) for d in s.focus], "baseline": [str(d) for d in s.baseline]} for s in SCENARIOS.values()}

    def contract(self) -> Response:
        c = self.engine.contract
        return 200, {"version": c.version, "hash": c.digest, "kpis": {k: c.lineage_card(k) for k in c.kpis}}

    def _series(self, kpi: str, persona: str) -> dict:
        """Points of a KPI at the persona's grain, with the rows that were left out."""
        rows = [(str(r["date"]), r["value"]) for r in self.engine.points(kpi, persona).collect()]
        src = self.engine.source_of(kpi)
        left = src.where("_quarantined").count() if "_quarantined" in src.columns else 0
        return {"points": rows, "excluded_rows": left}

    def _quality(self, persona: str) -> dict:
        """Defects; like all that shows counts it needs a known persona."""
        if persona not in PERSONAS:
            raise AccessDenied("UNKNOWN_PERSONA")
        return {"defects": [r.asDict() for r in self.engine.data.defects.collect()]}

    def _probe(self, persona: str, kpi: str, payload: object, grain: str | None = None) -> dict:
        """Would this payload pass for this persona? Raises like the engine would."""
        d = decide(persona, kpi, self.engine.contract.rules.get(kpi, {}), grain)
        if not d.granted:
            raise AccessDenied(f"{d.code}: {d.reason}")
        check_payload(payload, d)
        return {"granted": True, "trail": list(d.trail)}

    def audit(self, n: int = 50) -> Response:
        return 200, {"events": self.engine.audit.tail(n), "denials": len(self.engine.audit.denials())}

    def telemetry(self) -> Response:
        ms = sorted(h["ms"] for h in self.engine.history)
        return 200, {"n": len(ms), "min_ms": ms[0] if ms else None, "upper_median_ms": ms[len(ms) // 2] if ms else None, "max_ms": ms[-1] if ms else None}

    def boundary(self) -> Response:
        return 200, {"data_plane": "Spark DataFrames", "control_plane": "driver", "model_calls": "none unless a drafter is passed", "validated": True}

    def index(self) -> Response:
        routes: Mapping[str, str] = {"health": "GET", "personas": "GET", "scenarios": "GET", "contract": "GET", "data_quality": "GET", "series": "GET", "analyse": "POST", "probe": "POST", "intervention": "POST", "audit": "GET", "telemetry": "GET", "boundary": "GET"}
        return 200, {"routes": dict(routes)}
