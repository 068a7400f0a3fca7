import math
import random
import re

import pytest
from kpiscope.llm import entropy_mix as m
from kpiscope.llm.queries import op13_entropy_mix
from pyspark.sql import functions as F

from .conftest import DOCS, TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def brute_rates(sizes, target, cap=2):
    """Rates of least relative entropy, by bisection on the multiplier."""
    if target >= cap * sum(sizes) * (1 - 1e-12):
        return [float(cap) if x else 1.0 for x in sizes]
    low, high = -20.0, 20.0
    for _ in range(300):
        lam = (low + high) / 2
        got = sum(x * min(cap, math.exp(min(lam * x, 50))) for x in sizes)
        low, high = (lam, high) if got < target else (low, lam)
    return [min(cap, math.exp(min(lam * x, 50))) for x in sizes]


def made(spark, seed=3):
    r = random.Random(seed)
    names = ["b", "a", None, "", "É", "z", "hot", "rare"]
    rows = []
    for i in range(900):
        s = "hot" if i % 3 == 0 else names[r.randrange(len(names))]
        n = 7 if s == "hot" and i % 2 else int(r.paretovariate(1.1) * 3) % 400
        rows.append((i, " \t".join(["w"] * n) if n else r.choice([None, "", " \n"]), "en", s, 0))
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


def check(rows, got):
    sizes: dict = {}
    for _, t, _, s, *_ in rows:
        sizes.setdefault(s, []).append(len(WORD.findall(t or "")))
    want = brute_targets({s: sum(x) for s, x in sizes.items()})
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((d is None, d or 0) for d, *_ in rows)
    for s, x in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert sorted(r["size"] for r in mine) == sorted(x)
        assert {r["source_size"] for r in mine} == {sum(x)}
        assert all(r["target"] == pytest.approx(want[s], rel=1e-9) for r in mine)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(x) + 1e-6
        rates = brute_rates(x, want[s])
        assert sorted(r["rate"] for r in mine) == pytest.approx(sorted(rates), rel=1e-5)
        assert all(abs(r["copies"] - r["rate"]) < 2 for r in mine)


def test_against_brute_force(spark):
    rows, df = made(spark)
    got = m.mix(df).collect()
    check(rows, got)
    again = m.mix(df.repartition(2)).collect()
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(again, key=lambda r: r["doc_id"])


def test_query_runs_without_python(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = op13_entropy_mix(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString()
    got = df.collect()
    check([(i, t, "en", "s") for i, t in enumerate(TEXTS)], got)
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=3001)


def test_words_are_runs_of_other_characters(spark):
    texts = ["a b c", "\x1c x\x0by", "é😀 中", "", None, "\r\n\t ", "a" * 100_000 + " b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(m.words(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(WORD.findall(t or "")) for t in texts]


def test_odd_rows(spark, empty):
    assert m.mix(empty).count() == 0
    rows = [(1, "a b c", "en", "s", 0)] * 5 + [(None, None, None, None, None), (None, "x y", None, None, None), (2, "a " * 5, "en", "t", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "rank": F.lit("r"), "a.b": F.lit(2), "target": F.lit(0)})
    check(rows, m.mix(df).collect())
    blank = spark.createDataFrame([(1, None, "en", "s", 0), (2, " ", "en", None, 0)], DOCS)
    assert {(r["target"], r["taken"]) for r in m.mix(blank).collect()} == {(0.0, 0)}
    with pytest.raises(ValueError):
        m.mix(df, share=3)
    with pytest.raises(ValueError):
        m.mix(df, carry=["key"])


def test_expand_repeats_texts(spark):
    _, df = made(spark, 5)
    mixed = m.mix(df, carry=["text", "lang"]).cache()
    out = m.expand(mixed)
    assert out.select(F.sum(m.words(F.col("text")))).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
