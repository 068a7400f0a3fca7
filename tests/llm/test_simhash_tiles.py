import random

import numpy as np
from kpiscope.llm import simhash_tiles as s
from kpiscope.llm.queries import op6_simhash_tiles

from . import brute
from pyspark.sql import functions as F
from .conftest import DOCS, TEXTS


def test_query_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op6_simhash_tiles(spark, str(tmp_path)).collect()}
    prints = [brute.simhash(t or "", 4) for t in TEXTS]
    assert [got[i]["fingerprint"] for i in range(len(TEXTS))] == [f"{p:016x}" for p in prints]
    want = brute.components(list(range(len(TEXTS))), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert {i: got[i]["component_id"] for i in want} == want


def test_tiles_against_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 40, dtype=np.uint64)) for _ in range(30)])
    for radius in (0, 3, 4, 14):
        root = s.link_tiles(fps, None, 0, radius, 0.0)
        want = brute.components(list(range(len(fps))), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= radius)
        first = {r: min(np.flatnonzero(root == r)) for r in set(root.tolist())}
        assert [first[r] for r in root.tolist()] == [want[i] for i in range(len(fps))]


def test_strips_cover_all_counts():
    rng = np.random.default_rng(2)
    for n in (0, 5, 10**6, 10**8):
        counts = {p: int(c) for p, c in enumerate(rng.multinomial(n, np.full(65, 1 / 65)))}
        first, many, spans = s.strips_of(counts)
        for p in range(65):
            for k in range(many[p]):
                low, high = spans[first[p] + k]
                assert low <= p <= high


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(500, 500), (7, 3), (7, 3)]
    got = {r["node"]: r["root"] for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[200 + i] for i in range(50)} == {100} and 500 not in got
    assert s.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_high_similarity_go(spark, empty):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(800)]
    rows, i = [], 0
    for g in range(12):
        words = [rng.choice(vocabulary) for _ in range(300)]
        for c in range(4):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = "changed"
            rows.append((i, " ".join(w), "en", "s", 1))
            i += 1
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    kept = s.keep_one(docs)
    sets = [brute.shingles(r[1], 5) for r in rows]
    want = brute.components([r[0] for r in rows], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert s.keep_one(empty).count() == 0 and s.near_duplicates(empty, 4, 4, None).count() == 0


def test_similarities_about_the_threshold_are_exact(spark):
    """Pairs at 0.77 to 0.84: a sketch alone mistakes many of them."""
    rng = random.Random(11)
    rows = []
    for g in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        near = list(words)
        for k in rng.sample(range(10, 290, 8), 5 + g % 4):
            near[k] = "changed"
        rows += [(2 * g, " ".join(words), "en", "s", 1), (2 * g + 1, " ".join(near), "en", "s", 1)]
    sets = [brute.shingles(r[1], 5) for r in rows]
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)]
    assert min(share) < 0.8 <= max(share) and sum(0.78 <= v <= 0.85 for v in share) > 50
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(spark.createDataFrame(rows, DOCS), radius=64).collect()}
    assert [got[2 * g + 1] == 2 * g for g in range(150)] == [v >= 0.8 for v in share]
    assert all(got[2 * g] == 2 * g for g in range(150))


def test_candidates_behind_a_failed_pair_are_tried(spark, monkeypatch):
    """In a crowd of pairs below and above the threshold the components are those of all pairs."""
    rng = random.Random(12)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(20):
            words = list(base)
            for k in rng.sample(range(10, 290, 8), rng.randrange(1, 6)):
                words[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    sets = [brute.shingles(r[1], 5) for r in rows]
    want = brute.components([r[0] for r in rows], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(docs, radius=64).collect()}
    assert got == want
    monkeypatch.setattr(s, "GROUP_NODES", 7)  # groups of 20 in three tiles
    assert {r["doc_id"]: r["component_id"] for r in s.near_duplicates(docs, radius=64).collect()} == want


def test_repeated_lines_do_not_move_the_fingerprint():
    rng = random.Random(13)
    for n, times in ((300, 10), (300, 100), (1000, 100)):
        for _ in range(20):
            text = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            line = " ".join(f"l{rng.randrange(10**6)}" for _ in range(10))
            a, b = (" ".join([*text, *[line] * k]).encode() for k in (1, times))
            assert len(set(s.shingle_set(a, 5)) & set(s.shingle_set(b, 5))) >= 0.9 * len(s.shingle_set(b, 5))
            x, y = (s.fingerprint(t, 5, True)[0] for t in (a, b))
            assert ((x ^ y) & (1 << 64) - 1).bit_count() <= 14


def test_radius_reaches_pairs_at_the_threshold(spark):
    """Pairs that share 8 of 10 shingles, of small and large sets."""
    rng = random.Random(14)
    rows, pairs = [], []
    for g in range(600):
        n = (4, 36, 180)[g % 3]
        words = [f"w{rng.randrange(10**6)}" for _ in range(n + n // 4 + 4)]
        pairs.append((len(rows), len(rows) + 1))
        for w in (words[: n + 4], words):
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    for i, j in pairs:
        a, b = (brute.shingles(rows[k][1], 5) for k in (i, j))
        assert len(a & b) == 0.8 * len(a | b)
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[j] == i for i, j in pairs)


def test_clashing_names_text_ids_and_shared_ids(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [("d2", line, 1), ("d1", line + " more", 2), ("d1", "a text of its own that shares an id only", 3), (None, line, 4), ("d3", None, 5), ("d4", "", 6), ("d2", line, 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _gone int").withColumn("a.b", F.lit(0))
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    # The copy of d1 goes, the other text with an id d1 stays; texts without words are copies.
    assert sorted(r["_gone"] for r in kept.collect()) == [2, 3, 4, 5]
    got = s.near_duplicates(docs.drop("a.b")).collect()
    assert len(got) == 7 and {r["component_id"] for r in got if r["doc_id"] == "d2"} == {"d1"}


def test_components_of_many_nodes(spark, monkeypatch):
    """Those joined by broadcast get the same answer."""
    rng = random.Random(15)
    rows = []
    for g in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for k in range(30 if g < 2 else 2):
            rows.append((len(rows), " ".join([*base[: 190 + k % 10], f"x{k}"]), "en", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    plain = sorted(map(tuple, s.near_duplicates(docs).collect()))
    monkeypatch.setattr(s, "HOT_LEAST", 5)
    monkeypatch.setattr(s, "HOT_ROOTS", 10)
    assert sorted(map(tuple, s.near_duplicates(docs).collect())) == plain
    assert len({r[2] for r in plain}) == 8
