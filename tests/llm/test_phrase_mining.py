import random
import re
from collections import Counter

import numpy as np
import pytest
from kpiscope.llm import phrase_mining as m
from kpiscope.llm.queries import op11_phrase_mining
from pyspark.sql import functions as F

from .conftest import DOCS, TEXTS


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def pieces(text):
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lower(text or ""))]


def brute(rows, least=100, longest=5, top=2000):
    counts: dict = {}
    for lang, text in rows:
        c = counts.setdefault(lang if lang is not None else "und", Counter())
        for p in pieces(text):
            for k in range(1, longest + 1):
                c.update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        found = {k: a for k, a in c.items() if len(k) > 1 and a >= least}
        rows = []
        for w, a in found.items():
            inside = any(len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for v, b in found.items())
            if not inside:
                score, k = min((1000 * a * n // (c[w[:k]] * c[w[k:]]), k) for k in range(1, len(w)))
                rows.append((score, a, " ".join(w), c[w[:k]], c[w[k:]], n))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (s, a, p, l, r, n) in enumerate(rows[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["New", "york", "city", "é", "été", "中文", "the", "of", "x y", "a b", "a", "😀", "it's", "\x0bz", "q\x1c"]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!\r\n"]
    made = [(r.choice(["en", "fr", None, "und", ""]), "".join(r.choice(words[:3] if r.random() < 0.4 else words) + r.choice(gaps) for _ in range(r.randrange(80)))) for _ in range(120)]
    return made + [("en", t) for t in TEXTS] + [("en", "a a a a a a a"), ("en", "the new york city of the"), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0) for i, (g, t) in enumerate(rows)], DOCS).repartition(5)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("least", "top", "shard"), [(5, 2000, 30), (3, 7, 150_000)])
def test_against_brute_force(spark, rows, least, top, shard):
    want = brute(rows, least, 5, top)
    assert len(want) > 20
    assert got(m.mine(frame(spark, rows), least=least, top=top, shard=shard)) == want


def test_full_counters_lose_nothing(spark, rows, monkeypatch):
    """With 2^6 counters nearly all bounds hold; exact counts alone decide."""
    monkeypatch.setattr(m, "LEAST_BITS", 6)
    monkeypatch.setattr(m, "MOST_BITS", 6)
    monkeypatch.setattr(m, "FAN", 2)
    monkeypatch.setattr(m, "SEGMENT", 16)
    assert got(m.mine(frame(spark, rows), least=4)) == brute(rows, 4)


def test_query_and_large_products(spark, rows, tmp_path):
    many = rows + [("en", "alpha beta gamma. " * 150), ("de", "eins zwei " * 101)]
    frame(spark, many).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(op11_phrase_mining(spark, str(tmp_path))) == brute(many)
    one = spark.createDataFrame([("en", "a b", 3_000_000_000_000_000_000 // 10**6)], "lang string, phrase string, a long")
    w = spark.createDataFrame([("en", "a", 4 * 10**12), ("en", "b", 3 * 10**12)], "lang string, word string, f long")
    n = spark.createDataFrame([("en", 9 * 10**12)], "lang string, n long")
    assert m.scored(one, w, n).first()["score"] == 1000 * (3 * 10**12) * (9 * 10**12) // (12 * 10**24)


def test_slices_and_characters(monkeypatch):
    raw = b"Aa b\tc,D e\nf " * 50
    monkeypatch.setattr(m, "SLICE", 7)
    sliced = [w for part in m.tokens(raw) for w in part]
    monkeypatch.setattr(m, "SLICE", 1 << 20)
    assert sliced == [w for part in m.tokens(raw) for w in part]
    points = [m.character(i) for i in range(m.SHARD * 5)]
    assert len(set(points)) == len(points) and max(points) < 0x110000 and not any(0xD800 <= p < 0xE000 for p in points)


def test_scanner_counts_overlaps():
    s = m.Scanner(["a a", "a a a", "b a"])
    codes = np.array([1, 1, 1, 2, 1, 0, 1, 1])
    assert s.counts(["\n", "a", "b"], codes).tolist() == [3, 1, 1]
    assert s.counts(["\n", "c"], np.array([1, 1, 0])).tolist() == [0, 0, 0] and m.Scanner([]).counts(["\n", "a"], codes[:2]).tolist() == []


def test_equal_hashes_are_compared():
    codes = np.array([1, 2, 3, 4, 1, 2, 3, 4, 1, 2])
    places = np.array([0, 2, 4, 6, 8])
    grams = sorted((tuple(g), n) for g, n in m.distinct_grams(codes, places, np.zeros(5, np.uint64), 2))
    assert [g for g in grams if g[1]] == [((1, 2), 3), ((3, 4), 2)]


def test_odd_tables(spark, empty):
    assert m.mine(empty).count() == 0
    df = frame(spark, [(None, None), ("en", ""), ("en", ".,;")]).withColumns({"phrase": F.lit(1), "a.b": F.lit(2)})
    assert m.mine(df, least=1).count() == 0


def test_one_pass_however_many_candidates(spark, rows):
    """As many Spark jobs for many automata as for one: the blocks are not scanned once for each shard."""
    jobs = []
    for shard in (150_000, 10):
        spark.sparkContext.setJobGroup(f"shard {shard}", "")
        assert len(got(m.mine(frame(spark, rows), least=5, shard=shard))) > 20
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"shard {shard}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_scanner_with_many_first_words():
    """Words are digits, so that no node has a child for each of thousands of words."""
    words = [f"w{i}" for i in range(3000)]
    s = m.Scanner([f"{w} {v}" for w, v in zip(words, words[1:])])
    codes = np.concatenate([np.arange(1, 3001), [0], np.arange(1, 3001)])
    assert s.counts(["\n", *words], codes).tolist() == [2] * 2999
    assert s.digits.max() < m.FIRST + 16
