"""What may be said: claim grammar by status, number whitelist, text plan, validation.

Text never says more than the status allows, and holds no number that the facts lack.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from kpiscope.operators.identify import ASSOCIATION, DESIGN, INSUFFICIENT, INTERVENTION, NOT_POINT

FIXED = yaml.safe_load((Path(__file__).parent.parent / "plans" / "claims.yaml").read_text(encoding="utf-8"))
UNIVERSAL: tuple[str, ...] = tuple(FIXED["universally_forbidden"])
EXEMPT = frozenset(FIXED["exempt_numbers"])
PLACES: Mapping[str, str] = FIXED["places"]


@dataclass(frozen=True)
class Grammar:
    """What a status lets be said: types and words, how numbers may stand, and what must not be missing."""

    label: str
    quantification: str
    allowed_types: tuple[str, ...]
    forbidden_types: tuple[str, ...]
    allowed_verbs: tuple[str, ...]
    forbidden_verbs: tuple[str, ...]
    mandatory: tuple[str, ...]

    @property
    def sections(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(PLACES[m] for m in self.mandatory))


GRAMMAR: Mapping[str, Grammar] = {s: Grammar(**{k: tuple(v) if isinstance(v, list) else v for k, v in g.items()}) for s, g in FIXED["statuses"].items()}
#: From the strongest claim to none.
STRENGTH = (INTERVENTION, DESIGN, NOT_POINT, ASSOCIATION, INSUFFICIENT)
NUMERAL = re.compile(r"(?<![\w.+-])[-+]?\d[\d,]*(?:\.\d+)?")
#: Dates and the ids of evidence, claims, defects, hypotheses and places are no claims.
NO_CLAIM = re.compile(r"\b\d{4}-\d{2}-\d{2}\b|\b(?:EV|CLM|DQ|TR|H\d|SRC|PB|WH|ERP|CMP)[-_][-_A-Za-z0-9]*")


@dataclass(frozen=True)
class Statement:
    """A sentence or several of one section, of one type, about one hypothesis or none."""

    section: str
    text: str
    kind: str = "MEASURED_FACT"
    hypothesis: str | None = None


def renderings(v: float) -> set[str]:
    """The ways one number may be written: full, rounded, in lakh and crore, and without sign."""
    out: set[str] = set()
    for scaled in (v, v * 1e-5, v * 1e-7):
        for places in range(5):
            text = f"{abs(scaled):.{places}f}"
            out |= {text, text.rstrip("0").rstrip(".") if "." in text else text}
    return out


def numbers(facts: object, depth: int = 0) -> set[str]:
    """Every number of a nested structure, and numerals in its texts, to a depth of eight."""
    if depth > 8 or facts is None or isinstance(facts, bool):
        return set()
    if isinstance(facts, (int, float)):
        return renderings(float(facts)) if facts == facts and abs(facts) != float("inf") else set()
    if isinstance(facts, str):
        return {r for m in NUMERAL.findall(facts) for r in renderings(float(m.replace(",", "")))}
    if isinstance(facts, Mapping):
        return set().union(*(numbers(v, depth + 1) for v in facts.values()), *(numbers(k, depth + 1) for k in facts))
    if isinstance(facts, Iterable):
        return set().union(*(numbers(v, depth + 1) for v in facts))
    return numbers(str(facts), depth + 1)


@dataclass(frozen=True)
class ClaimContract:
    status: Mapping[str, str]
    allowed: frozenset[str]
    entities: frozenset[str]
    foreign: frozenset[str]
    required: tuple[str, ...]
    locked: tuple[str, ...]
    max_words: int
    digest: str

    @property
    def forbidden(self) -> set[str]:
        """Phrases that no status among the claims allows, and those that none ever does."""
        used = {GRAMMAR[s] for s in self.status.values()} or {GRAMMAR[INSUFFICIENT]}
        return set(UNIVERSAL) | set.intersection(*(set(g.forbidden_verbs) for g in used))

    @property
    def mandatory(self) -> tuple[str, ...]:
        """Sections that the strongest of the statuses asks for."""
        return GRAMMAR[strongest(self.status.values())].sections


def strongest(statuses: Iterable[str]) -> str:
    return min(statuses, key=STRENGTH.index, default=INSUFFICIENT)


def build(facts: Mapping[str, object], status: Mapping[str, str], entities: Iterable[str], foreign: Iterable[str], required: Sequence[str], locked: Sequence[str], max_words: int) -> ClaimContract:
    allowed = numbers(facts) | numbers(list(locked)) | numbers(derived(facts))
    blob = json.dumps([sorted(allowed), dict(status), sorted(required), list(locked)], sort_keys=True, default=str)
    return ClaimContract(dict(status), frozenset(allowed), frozenset(entities), frozenset(foreign), tuple(required), tuple(locked), max_words, hashlib.sha256(blob.encode()).hexdigest()[:16])


@dataclass
class Validation:
    faults: list[tuple[str, str]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.faults


def phrase(text: str, words: str) -> bool:
    return re.search(r"\b" + r"\s+".join(map(re.escape, words.split())) + r"\b", text, re.I) is not None


def claimed_numbers(text: str) -> list[str]:
    """Numerals that claim something: no dates, ids or literals of everyday method."""
    found = [n.lstrip("+-").replace(",", "") for n in NUMERAL.findall(NO_CLAIM.sub(" ", text))]
    return [n for n in found if n not in EXEMPT]


def sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?])\s+", text)


def validate(sections: Mapping[str, str], contract: ClaimContract) -> Validation:
    """V1 words, V2 numbers, V3 entities, V4 sections, V5 locked sentences, V6 how numbers stand."""
    out, text = Validation(), "\n".join(sections.values())
    out.faults += [("V1", f"{p!r} is not allowed") for p in sorted(contract.forbidden) if phrase(text, p)]
    for h, status in contract.status.items():
        lines = [s for s in sentences(text) if phrase(s, h.replace("_", " "))]
        g = GRAMMAR[status]
        out.faults += [("V1", f"{p!r} about {h}, which is {status}") for s in lines for p in g.forbidden_verbs if phrase(s, p)]
        if g.quantification != "INTERVAL":
            for s in lines:
                if phrase(s, "interval") or claimed_numbers(s) and (g.quantification == "DESCRIPTIVE" or not phrase(s, "association")):
                    out.faults.append(("V6", f"a magnitude about {h}, which is {status}"))
    out.faults += [("V2", f"number {n} has no source") for n in claimed_numbers(text) if n not in contract.allowed]
    out.faults += [("V3", f"{e} is out of scope") for e in sorted(contract.foreign) if phrase(text, e)]
    out.faults += [("V4", f"section {s} is missing") for s in contract.required if not sections.get(s)]
    out.faults += [("V5", f"locked sentence is missing: {s[:40]}") for s in contract.locked if s not in text]
    return out


def type_faults(statements: Iterable[Statement], status: Mapping[str, str]) -> list[tuple[str, str]]:
    """V7: statements of a type that their hypothesis' status does not allow."""
    return [("V7", f"{x.kind} about {x.hypothesis}, which is {status[x.hypothesis]}") for x in statements if x.hypothesis in status and (x.kind in GRAMMAR[status[x.hypothesis]].forbidden_types or x.kind not in GRAMMAR[status[x.hypothesis]].allowed_types)]


@dataclass(frozen=True)
class Profile:
    sections: tuple[str, ...]


PROFILES: Mapping[str, Profile] = {p: Profile(tuple(s)) for p, s in FIXED["profiles"].items()}


def effect_size(e: Mapping[str, object]) -> tuple[float, float, float, str]:
    """Estimate, low, high and unit as a reader sees them: a panel's effect is of logarithms and is told in percent."""
    if e["kind"] == "DID":
        return (*(100 * math.expm1(float(e[k])) for k in ("estimate", "low", "high")), "percent")
    return (*(float(e[k]) for k in ("estimate", "low", "high")), "units in total")


def derived(a: Mapping[str, object]) -> dict[str, object]:
    """Numbers that sentences hold and facts hold in another form."""
    out: dict[str, object] = {"sizes": [], "months": []}
    for h in a.get("hypotheses") or ():
        if isinstance(h, Mapping) and h.get("status") in (DESIGN, INTERVENTION) and h.get("effect"):
            out["sizes"] += effect_size(h["effect"])[:3]
        if isinstance(h, Mapping) and h.get("exposure_per_day") is not None:
            out["months"].append(30 * float(h["exposure_per_day"]))
    return out


def _driver(h: Mapping[str, object]) -> str:
    return str(h["driver"]).replace("_", " ")


def about(h: Mapping[str, object]) -> list[Statement]:
    """What may be said of a hypothesis, numbers and words as its status allows."""
    name, status, e = _driver(h), str(h["status"]), h.get("effect") or {}

    def say(text: str, kind: str) -> Statement:
        return Statement("drivers", text, kind, str(h["driver"]))

    if status in (DESIGN, INTERVENTION):
        size, low, high, unit = effect_size(e)
        verb = "reduced" if size < 0 or status == INTERVENTION else "increased"
        lead = "Under the stated assumptions" if status == DESIGN else "The observed recovery is consistent with the prediction: under the stated assumptions"
        text = f"{lead}, {name} is estimated to have {verb} the outcome by {abs(size):.2f} {unit} (95 percent interval {low:.2f} to {high:.2f})."
        return [say(text, "CAUSAL_EFFECT_CONDITIONAL")]
    r = e.get("r")
    if status == NOT_POINT:
        first = "is the leading hypothesis for the movement" if h.get("rank", 1) == 1 else "cannot be ruled out as a contributor to the movement"
        out = [say(f"{name.capitalize()} {first}, but its effect is not identified.", "HYPOTHESIS_RANKING")]
        if r is not None:
            out.append(say(f"The association of {name} with the outcome is {r:.2f}, which is no effect.", "MEASURED_FACT"))
        return out
    if status == ASSOCIATION:
        size = f" (association {r:.2f})" if r is not None else ""
        return [say(f"{name.capitalize()} was associated with the outcome{size}; no timing and no effect is claimed.", "ASSOCIATION")]
    return [say(f"The part of {name} cannot be assessed from the data at hand.", "ABSTENTION")]


def sentence(h: Mapping[str, object]) -> str:
    return " ".join(x.text for x in about(h))


def money(v: float) -> str:
    return f"{v:.2f}"


def exposure(a: Mapping[str, object]) -> list[Statement]:
    """What is at stake a day and month, where it comes from, and how it was ranked."""
    out = []
    for h in a["hypotheses"][:1]:
        v = h.get("exposure_per_day")
        if v is not None and math.isfinite(v):
            kind = "an estimated effect" if h["status"] in (DESIGN, INTERVENTION) else "a change of value and no effect"
            out.append(Statement("exposure", f"At stake are {money(v)} a day ({money(30 * v)} a month of 30 days), {kind}.", "ARITHMETIC_CONTRIBUTION"))
        out.append(Statement("exposure", f"Impact is {_plain(h['impact_tier'])}, evidence {_plain(h['statistical_tier'])}, priority {_plain(h['priority'])}."))
    return out


def _plain(v: object) -> str:
    return str(v).lower().replace("_", " ")


def operational(a: Mapping[str, object], most: int = 4) -> list[Statement]:
    """Readings of operations that support a hypothesis."""
    found = [e for e in a["evidence"] if e["stance"] == "SUPPORT" and e["evidence_type"] in ("OPERATIONAL_METRIC", "TICKET_CLUSTER")]
    return [Statement("operational", f"{e['statement'][:1].upper()}{e['statement'][1:]} (source {e['source']}).") for e in found[:most]]


def affected(a: Mapping[str, object]) -> list[Statement]:
    """Where the reader's scope and the affected places meet."""
    out = [Statement("affected", f"In scope are {', '.join(a['regions'])} at the grain {_plain(a['grain'])}.")]
    hurt = sorted({r for e in a["evidence"] if e["stance"] == "SUPPORT" for r in a["regions"] if phrase(str(e["statement"]), r)})
    if hurt:
        out.append(Statement("affected", f"Operations moved in {', '.join(hurt)}."))
    return out


def limits(a: Mapping[str, object], most: int = 4) -> list[Statement]:
    """Assumptions of the leading hypothesis that are violated or unknown."""
    rows = [x for h in a["hypotheses"][:1] for x in h["assumptions"]]
    bad = [x for x in rows if x["state"] in ("VIOLATED", "UNKNOWN")]
    out = [Statement("limits", f"That {x['text']} is {_plain(x['state'])} ({x['code']}).") for x in bad[:most]]
    held = [x["code"] for x in rows if x["state"] == "SATISFIED"]
    if held:
        out.append(Statement("limits", f"Checked and held: {', '.join(held)}."))
    return out


def contradicting(a: Mapping[str, object]) -> list[Statement]:
    found = [e for e in a["evidence"] if e["stance"] == "CONTRADICT"]
    if not found:
        return [Statement("contradicting", "No evidence against was found, which is no evidence for.")]
    return [Statement("contradicting", f"Against: {e['statement']} (source {e['source']}).") for e in found]


def method(a: Mapping[str, object]) -> list[Statement]:
    """How each hypothesis was identified, and by what adjustment."""
    out = []
    for h in a["hypotheses"]:
        s, e = h.get("strategy") or {}, h.get("effect") or {}
        way = "no design qualified" if e.get("kind") not in ("DID", "ITS") else "a panel of cells" if e["kind"] == "DID" else "an interrupted series"
        given = ", ".join(map(str, s.get("set") or [])).replace("_", " ") or "nothing"
        out.append(Statement("method", f"For {_driver(h)} the graph gives {_plain(s.get('strategy', 'NONE'))}, adjusting for {given}; {way}."))
    return out


def diagnostics(a: Mapping[str, object]) -> list[Statement]:
    """Which checks of robustness each hypothesis passed."""
    out = []
    for h in a["hypotheses"]:
        checks = h.get("robustness") or {}
        if checks:
            text = ", ".join(f"{_plain(k)} {'passed' if v['pass'] else 'failed'}" for k, v in sorted(checks.items()))
            out.append(Statement("diagnostics", f"Checks of {_driver(h)}: {text}."))
    return out or [Statement("diagnostics", "No design was estimated, so no check applies.")]


def statements(a: Mapping[str, object], persona: str) -> list[Statement]:
    """The sections of a persona's profile, and abstention, clarification and benchmark where
    the analysis has them. ``a`` is the analysis result."""
    m, hyp = a["movement"], a["hypotheses"]
    crossed = "beyond" if a.get("alert") else "within"
    moved = "cannot be compared with an earlier period" if m["pct"] is None else f"changed by {m['pct']:.2f} percent, {crossed} its threshold"
    label = f" Status: {GRAMMAR[strongest(h['status'] for h in hyp)].label}." if hyp else ""
    test = f"The permutation test gives p {m['p']:.4f}." if m["p"] is not None else "The history is too short for a test."
    arithmetic = [Statement("decomposition", f"{t['term'].capitalize()}: {t['pp']:.2f} points of the movement, as an identity.", "ARITHMETIC_CONTRIBUTION") for t in a.get("decomposition", [])]
    actions = [Statement("actions", f"{r['rank']}: {r['playbook_id']}.") for r in a["recommendations"]]
    makers = {
        "headline": lambda: [Statement("headline", f"{str(a['kpi']).replace('_', ' ').capitalize()} {moved}.{label}")],
        "movement": lambda: [Statement("movement", test)],
        "exposure": lambda: exposure(a) or [Statement("exposure", "No exposure is known.")],
        "decomposition": lambda: arithmetic or [Statement("decomposition", "No decomposition applies.")],
        "drivers": lambda: [x for h in hyp for x in about(h)] or [Statement("drivers", "No driver was examined.")],
        "operational": lambda: operational(a) or [Statement("operational", "No reading of operations stands out.")],
        "affected": lambda: affected(a),
        "limits": lambda: limits(a) or [Statement("limits", "No design rests on assumptions here.")],
        "contradicting": lambda: contradicting(a),
        "method": lambda: method(a) or [Statement("method", "No driver was examined.")],
        "diagnostics": lambda: [Statement("diagnostics", test), *diagnostics(a)],
        "actions": lambda: actions or [Statement("actions", "No action is licensed.")],
        "gaps": lambda: [Statement("gaps", g, "DATA_REQUIREMENT") for g in a["gaps"]] or [Statement("gaps", "No gap is known.")],
    }
    out = [x for s in PROFILES[persona].sections for x in makers[s]()]
    out += [Statement(s, str(a[s]["text"]), k) for s, k in (("abstention", "ABSTENTION"), ("clarification", "CLARIFICATION_REQUEST"), ("benchmark", "BENCHMARK_COMPARISON")) if a.get(s)]
    return out


def plan(a: Mapping[str, object], persona: str) -> dict[str, str]:
    """``statements`` as texts by section."""
    out: dict[str, str] = {}
    for x in statements(a, persona):
        out[x.section] = f"{out[x.section]} {x.text}" if x.section in out else x.text
    return out


def fit_words(sections: Mapping[str, str], required: Sequence[str], most: int) -> dict[str, str]:
    """The sections within ``most`` words: those that are not required go first, from the end, then
    required ones are cut at a sentence, from the end; the first section stays whole."""
    out = dict(sections)

    def words() -> int:
        return sum(len(t.split()) for t in out.values())

    for name in reversed([s for s in sections if s not in required]):
        if words() > most:
            del out[name]
    for name in list(reversed(out))[:-1]:
        parts = re.split(r"(?<=[.!?])\s+", out[name])
        while words() > most and len(parts) > 1:
            parts.pop()
            out[name] = " ".join(parts)
    return out


def render(sections: Mapping[str, str], contract: ClaimContract, draft=None, max_calls: int = 2) -> dict[str, object]:
    """A drafter (a callable from sections to sections) may rewrite, at most ``max_calls`` times;
    what does not pass is dropped for the template, and a template that does not pass for the
    locked sentences alone."""
    for n in range(max_calls if draft else 0):
        got = draft(dict(sections))
        if validate(got, contract).ok:
            return {"mode": "MODEL", "sections": got, "calls": n + 1}
    calls = max_calls if draft else 0
    checked = validate(sections, contract)
    if checked.ok:
        return {"mode": "TEMPLATE", "sections": dict(sections), "calls": calls}
    safe = {s: "This section was withheld." for s in contract.required} | {"headline": " ".join(contract.locked) or "The text was withheld."}
    return {"mode": "DEGRADED", "sections": safe, "calls": calls, "faults": checked.faults}


#: In order of urgency; the first that applies is asked.
QUESTIONS = (
    ("COVERAGE_GAP", "Can the missing feed for {slot} be supplied?"),
    ("COARSE_GRAIN", "Is {slot} available by day rather than week?"),
    ("CONFOUNDER", "Is there any record of {slot}?"),
    ("STALE_SOURCE", "When will {slot} be refreshed?"),
    ("SPARSE_HISTORY", "Can the comparison wait until {slot}?"),
    ("SCOPE", "Which of {slot} is meant?"),
)


def clarification(found: Mapping[str, str]) -> dict[str, str] | None:
    """The question of the most urgent kind found; ``found`` maps kinds to what fills the slot."""
    for kind, text in QUESTIONS:
        if kind in found:
            return {"kind": kind, "text": text.format(slot=found[kind])}
    return None


def abstain(statuses: Sequence[str]) -> dict[str, str] | None:
    if any(s in (DESIGN, INTERVENTION) for s in statuses):
        return None
    return {"text": "No cause of this movement is identified by the data at hand."}
