import pickle
import random
import tracemalloc

from kpiscope.llm import suffix_decontam as d

from . import brute
from .conftest import DOCS

ITEMS = [
    (0, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda."), (1, "short item here"), (2, ""), (3, None), (4, "short item here"), (5, "été à la plage"),
]


def test_automaton_against_windows():
    rng = random.Random(2)
    for _ in range(1500):
        letters = "abcd"[: rng.randint(1, 4)]
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(0, 4))]
        size = rng.randint(1, 5)
        text = " ".join(rng.choice(letters + "x") for _ in range(rng.randint(0, 25)))
        group = pickle.loads(pickle.dumps(d.build([(i, t.encode()) for i, t in items], size, rng.choice([2, 7, d.AUTOMATON_WORDS]))))
        ranges, found = group.match(d.words_of(text.encode()))
        n, hit, who = brute.windows(items, text, size)
        assert {k for a, b in ranges for k in range(a, b)} == hit and found == set(map(str, who))


def test_report_shards_and_edges(spark, empty):
    texts = [
        "x ALPHA, beta-gamma delta (epsilon) zeta eta theta iota kappa! y", "alpha beta gamma delta epsilon zeta eta theta iota", "a short item HERE b short item here", None, "", "l'ÉTÉ à la plage", "l'été à la plage",
        "x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda alpha beta gamma delta epsilon zeta eta theta iota kappa",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts + texts)], DOCS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    plain = [(i, t or "") for i, t in ITEMS]
    for sizes in ({}, {"group_words": 5}, {"automaton_words": 3}, {"group_words": 12, "automaton_words": 4}):
        got = d.scan(docs, bench, **sizes).collect()
        assert len(got) == len(texts) * 2
        for r in got:
            n, hit, who = brute.windows(plain, texts[r["doc_id"] % len(texts)] or "", 10)
            assert r["n_words"] == n and {k for h in r["hit"] for k in range(h["start"], h["end"])} == hit and r["items"] == sorted(map(str, who))
    rep = {r["doc_id"]: r for r in d.report(docs, bench).collect()}
    assert rep[2]["n_items"] == 2 and rep[2]["contaminated"] and rep[2]["items_sha256"] == brute.sha("1,4") and not rep[1]["contaminated"]
    assert d.report(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in d.report(docs, bench.where("false")).collect())


def test_decontaminate(spark):
    keep = "Something else entirely that stays. " * 3
    texts = [keep + "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda. " + keep, "alpha beta gamma delta epsilon zeta eta theta iota kappa", keep, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    out = d.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == docs.columns and rows == {0: keep + keep, 2: keep, 3: None, 4: ""}


def test_coverage_is_judged_over_all_items(spark):
    """Two passages are most of a text, each alone is not: sizes of groups change nothing."""
    items = [(0, "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"), (1, "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10 b11 b12")]
    filler = " ".join(f"w{i}" for i in range(11))
    texts = [f"{items[0][1]} {filler} {items[1][1]}", f"{items[0][1]} {filler} {filler}", f"{filler} {items[1][1]} {filler}"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {1: f"{filler} {filler}", 2: f"{filler} {filler}"}
    for sizes in ({}, {"group_words": 5}, {"automaton_words": 5}):
        assert {r["doc_id"]: r["text"] for r in d.decontaminate(docs, bench, **sizes).collect()} == want


def test_clashing_names_empty_tables_and_null_ids(spark, empty):
    docs = spark.createDataFrame([(1, "x short item here y and some of the more words", 5), (1, None, 6)], "`a.b` long, text string, hit long")
    bench = spark.createDataFrame([(None, "short item here"), (7, "Short item, here"), (None, "more words")], "item_id long, text string")
    out = d.decontaminate(docs, bench)
    assert out.columns == docs.columns and sorted(r["text"] or "" for r in out.collect()) == ["", "x y and some of the "]
    row = d.scan(docs.withColumnRenamed("a.b", "doc_id"), bench).where("n_words > 0").first()
    assert row["items"] == ["7", None]
    assert d.decontaminate(empty, bench, group_words=2).count() == 0
    assert d.decontaminate(docs, bench.where("false")).count() == 2


def test_a_large_benchmark_needs_little_memory():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(20000)]
    items = [(i, " ".join(rng.choices(words, k=50)).encode()) for i in range(4000)]  # 200 000 words
    tracemalloc.start()
    group = d.build(items, 10, 50_000)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(group.automata) > 3 and kept < 50 << 20  # 2 000 000 words: under 500 MB
    assert group.match(d.words_of(b"x " + items[17][1])) == ([(1, 51)], {"17"})
