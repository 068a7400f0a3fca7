import numpy as np
import random

from kpiscope.llm import pii_crf
from kpiscope.llm.queries import op2_pii_crf

from . import brute
from .conftest import TEXTS


def test_base_spans_against_patterns():
    rng = random.Random(4)
    pieces = list("0123456789.@+- ()aZ_é%") + ["@a.b", "1.2.3.4", "+12 345 678 90", "4111 1111 1111 1111"]
    for _ in range(20000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert sorted(pii_crf.base_spans(t)) == sorted(brute.pii(t)), t
    for t in TEXTS:
        assert sorted(pii_crf.base_spans(t or "")) == sorted(brute.pii(t or ""))


def test_long_runs_are_linear():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "@" * 50_000, "+1" + " " * 100_000, "a@" * 50_000):
        pii_crf.base_spans(t)


def test_field_generalises_and_adds():
    field = pii_crf.default_field()
    held_out = pii_crf.expand(seed=99, times=2)
    got = pii_crf.field_spans([t for t, _ in held_out], field, [[] for _ in held_out])
    wanted = [[s for s in spans if pii_crf.plausible(s[0], t[s[1] : s[2]])] for t, spans in held_out]
    right = sum(sorted(g) == sorted(w) for g, w in zip(got, wanted))
    assert right / len(held_out) > 0.9
    (_, spans) = pii_crf.find(["call (555) 123-4567 now"], field)[0]
    assert spans == [("phone", 5, 19)]
    (base, spans) = pii_crf.find(["+1 (826) 555-4081 4111111111111111 z"], field)[0]
    assert ("phone", 0, 17) in spans and set(base) <= set(spans)
    assert pii_crf.find(["In 1999, 2000 and 2001-2002 it sold 12345 units at 3.14."], field)[0] == ([], [])


def test_query(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op2_pii_crf(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        base = sorted(brute.pii(t or ""), key=lambda s: (brute.KINDS.index(s[0]), s[1]))
        assert got[i]["base_sha256"] == brute.sha(brute.joined(base))
        assert [got[i][f"n_{k}"] for k in brute.KINDS] == [sum(s[0] == k for s in base) for k in brute.KINDS]
        assert set(brute.joined(base).split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert pii_crf.scan(empty).count() == 0


def test_mask_keeps_rows_and_columns(docs):
    out = pii_crf.mask(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[0] == "Mail <EMAIL> or <PHONE>, from <IP>."
    assert rows[2] is None and rows[1] == "" and rows[7] == TEXTS[7]


#: Templates that the labelled table does not have; {..} is the span.
OTHERS = (
    "Please reach me at home: {email:maria.k at posta dot es} any time",
    "kontakt {email:anna (at) firma (dot) de} oder Brief",
    "Her desk, {phone:555-301-4477}, is open until noon",
    "Tel.: {phone:(212) 555-0187} or at the door",
    "ask {email:jo.do at uni dot fr} about the boat",
    "server {ip:10.20.30.40} went down at 12:30",
    "The year 1984 and pages 12-19 of volume 3",
    "We look at the dot over the i, at home",
    "invoice 20231 of 14.03.2021 over 1,250.00",
    "555.666.777.888 is no address",
    "le point dot de vue at ease",
    "{email:john at example dot de}",
    "call {phone:0171 2345678} now",
    "escribe a {email:maria arroba correo punto es} hoy",
    "we met at the dot com of the year",
    "appelez le {phone:01 42 68 53 00} demain",
    "Rufen Sie {phone:030 4407716} an, bitte",
    "son adresse : {email:luc.b arobase mairie point fr}, merci",
    "von {email:eva at kanzlei punkt de} kam ein Brief",
    "au point de vue de la loi, un point fr est rare",
    "en el punto de partida, a las 10 y 0,5 km",
    "Die Zahl 0815 und der Punkt der Ordnung",
    "room 012 of 340 at the end",
)


def test_other_templates_than_the_trained_ones():
    import re

    field, right, wanted, found = pii_crf.default_field(), 0, 0, 0
    for line in OTHERS:
        text, spans = "", set()
        for part in re.split(r"(\{[^}]*\})", line):
            if part.startswith("{"):
                kind, value = part[1:-1].split(":", 1)
                spans.add((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += part
        got = set(pii_crf.find([text], field)[0][1])
        right, wanted, found = right + len(got & spans), wanted + len(spans), found + len(got)
    assert right / wanted >= 0.8 and right / max(1, found) >= 0.8


def test_viterbi_finds_the_best_of_all_labellings():
    from itertools import product

    rng = np.random.default_rng(1)
    k = len(pii_crf.LABELS)
    field = pii_crf.Field({"": 0, "edge": 1, "gap": 2, "s:x1": 3, "s:d2": 4}, rng.normal(size=(len(pii_crf.OFFSETS), 5, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    rows = [rng.integers(0, 5, (n, 3)) for n in (1, 2, 4)]
    batch, sizes = pii_crf.pad(rows)
    path, e = field.viterbi(batch, sizes), field.emissions(batch)
    for i, n in enumerate(sizes):
        def score(y):
            return field.start[y[0]] + sum(e[i, t, y[t]] for t in range(n)) + sum(field.step[y[t - 1], y[t]] for t in range(1, n))

        assert tuple(path[i, :n]) == max(product(range(k), repeat=int(n)), key=score)
