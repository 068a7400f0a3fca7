import random
import zlib

import numpy as np
import pytest
from kpiscope.llm import quality_cnn as q


def test_tables_equal_a_direct_convolution():
    rng = np.random.default_rng(0)
    net = q.Network(rng.normal(size=(q.WIDTH, 256, q.FILTERS)), rng.normal(size=q.FILTERS), rng.normal(size=q.FILTERS), 0.3)
    chunk = rng.integers(0, 256, (3, q.CHUNK)).astype(np.uint8)
    for row, got in zip(chunk, net.logits(chunk)):
        y = np.array([sum(net.filters[k, row[p + k]] for k in range(q.WIDTH)) + net.bias for p in range(q.CHUNK - q.WIDTH + 1)])
        assert got == pytest.approx(np.maximum(y.max(0), 0) @ net.out + 0.3, abs=1e-4)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 960, 961, 5000])
def test_chunks_cover_the_whole_text(n):
    seen = np.zeros(max(n, q.CHUNK), bool)
    for s in q.chunk_starts(n):
        seen[s : s + q.CHUNK] = True
    assert seen[:n].all() and (n <= q.CHUNK or q.chunk_starts(n)[-1] + q.CHUNK == n)


def corpus(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 400))]
        rows.append((i, " ".join(words) if good else " | ".join(words), "en", "s", 1))
        labels.append((i, int(good), 0))
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (402, "", "en", "s", 0)]
    labels += [(400, None, 0), (5, 1, 0), (99999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels, rows, truth = corpus(spark)
    got = {r["doc_id"]: r["score"] for r in q.score(docs, q.fit(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 4 != 0) for i in held]) > 0.95
    assert got[400] == got[401] == got[402] and 0 <= got[400] <= 1
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert set(q.held_out.__code__.co_varnames) == {"doc_id"}


def test_one_class_none_and_empty(spark):
    docs, labels, _, _ = corpus(spark)
    assert {round(r["score"], 3) for r in q.score(docs.limit(3), q.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert all(r["score"] > 0.99 for r in q.score(docs.limit(3), q.fit(docs, labels.where("quality = 1"))).collect())
    assert q.score(docs.where("false"), q.fit(docs, labels.where("false"))).count() == 0


def test_empty_documents_and_texts_of_one_class(spark):
    docs, labels, _, _ = corpus(spark)
    none = docs.where("false")
    assert q.score(none, q.fit(none, labels)).count() == 0 and q.keep_good(none, labels).count() == 0
    # Of the labelled documents only those of one class are there: the labels' share.
    some = docs.where("doc_id % 4 != 0")
    assert {0.7 < r["score"] < 0.85 for r in q.score(some, q.fit(some, labels)).limit(5).collect()} == {True}


def test_clashing_names_and_text_ids(spark):
    docs, labels, rows, _ = corpus(spark)
    named = docs.selectExpr("concat('d', doc_id) doc_id", "text", "1 _score", "2 `a.b`", "3 score")
    marked = labels.selectExpr("concat('d', doc_id) doc_id", "quality")
    kept = q.keep_good(named, marked)
    assert kept.columns == named.columns and 200 < kept.count() < 350 and {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3)}


def test_whole_texts_are_learned_from(spark):
    """What tells the classes apart stands in the middle of long texts only."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        words = ["".join(rng.choice("aeiourstln") for _ in range(5)) for _ in range(1500)]
        if i % 2:
            words[400:1100] = ["q#x#z"] * 700
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in q.score(docs, q.fit(docs, labels)).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] > 0.5) == bool(i % 2) for i in held]) > 0.95


def test_the_query_against_labels(spark):
    """The registered query on the smallest tables: every row, held-out rows as stated, accuracy."""
    from kpiscope.llm.queries import op5_quality_cnn

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op5_quality_cnn(spark, sf).collect()}
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(got) == sorted(ids)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([got[i]["predicted"] == v for i, v in truth.items() if v == 1]) > 0.95
