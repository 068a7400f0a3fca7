import numpy as np
import pytest
from kpiscope.llm import ann_anisotropic as a
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string").repartition(4)


def brute(rows, k=10):
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v is not None and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 10 == 0:
            d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
            out[q] = d
    return out


def test_recall_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] * rng.uniform(0.5, 2) + 0.3 * rng.normal(size=24)).tolist(), "x") for i in range(900)]
    rows += [(1000 + i, rows[7][1], "copy") for i in range(300)]
    rows += [(5000, None, ""), (5001, [], ""), (5002, [0.0] * 24, ""), (5003, [float("nan")] * 24, ""), (5004, [None] + [1.0] * 23, ""), (5005, [1.0] * 5, ""), (5006, [float("inf")] * 24, ""), (5010, [0.0] * 24, "")]
    got = {}
    for r in a.nearest(frame(spark, rows), F.col("id") % 10 == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(x[1:] <= y[1:] for x, y in zip(mine, mine[1:]))
        hits += len({m[2] for m in mine} & {v for _, v in near})
    assert hits / (10 * len(want)) >= 0.9
    # All copies of vector 7: the smallest ids come first.
    assert [m[2] for m in sorted(got[1000])] == [7, *range(1001, 1010)]


def test_crowds_of_near_copies(spark):
    """Neighbours within a crowd that shares codes, and outside it."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    rows = [(i, (centre + 0.01 * rng.normal(size=24)).tolist(), "") for i in range(1500)]
    rows += [(2000 + i, rng.normal(size=24).tolist(), "") for i in range(1500)]
    got = {}
    for r in a.nearest(frame(spark, rows), F.col("id") % 100 == 0, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = np.array([np.array(v, np.float32) for _, v, _ in rows], float)
    ids = np.array([r[0] for r in rows])
    hits = {True: [], False: []}
    for k in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[k]) ** 2).sum(1)
        d[k] = np.inf
        hits[bool(ids[k] < 1500)].append(len(got[int(ids[k])] & set(ids[np.argsort(d)[:10]].tolist())) / 10)
    assert np.mean(hits[True]) >= 0.9 and np.mean(hits[False]) >= 0.9


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0], ""), (1, [1.0, 2.0], ""), (2, [3.0, 2.0], "")]
    got = a.nearest(frame(spark, rows), F.col("id") == 0, k=10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 0.0), (2, pytest.approx(2.0))]
    assert a.nearest(frame(spark, []), F.col("id") == 0).count() == 0


def test_parallel_error_is_penalised():
    rng = np.random.default_rng(4)
    x = a.padded(rng.normal(size=(600, 14)))
    plain, wise = (a.fit(x, eta=e) for e in (1.0, 4.0))

    def parallel(book):
        c = book.encode(x)
        back = np.concatenate([book.centroids[s][c[:, s]] for s in range(len(book.centroids))], 1)
        return ((((x - back) * x).sum(1) / np.sqrt((x**2).sum(1))) ** 2).mean()

    assert parallel(wise) < parallel(plain)
