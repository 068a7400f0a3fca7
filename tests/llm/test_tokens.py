import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kpiscope.llm import bpe_segment, chunks, token_packing
from kpiscope.llm.queries import op3_token_packing, op4_bpe_segment, vocabulary
from tokenizers import Tokenizer

from . import brute
from .conftest import TEXTS

TOK = Tokenizer.from_file(vocabulary())
BPE = bpe_segment.load(vocabulary())
LIB = token_packing.library(vocabulary())


def reference(text):
    return TOK.encode(text, add_special_tokens=False).ids


ALPHABET = st.sampled_from(list("abe  \n\t'sré<|>ñ\x1c\x85Ⅷ²12中😀ß.,!—\u0301\r") + ["<|endoftext|>", " the", "'ll", " \n", "\n "])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_both_encoders_equal_the_library(text):
    want = reference(text)
    assert BPE.encode([text])[0].tolist() == want
    ids, counts = LIB.encoder([text])
    assert ids.tolist() == want and counts.tolist() == [len(want)]
    assert BPE.decode(np.array(want, np.int64)) == TOK.decode(want, skip_special_tokens=False)


def test_long_words_and_many_texts():
    rng = random.Random(1)
    texts = ["a" * 3000, "ab" * 1500, "x" * 256, "x" * 257, " " * 700, "", "\n"] + [" ".join("".join(rng.choice("aeioùst,.") for _ in range(rng.randint(1, 12))) for _ in range(50)) for _ in range(200)]
    for got, lib, t in zip(BPE.encode(texts), np.split(*[LIB.encoder(texts)[0], np.cumsum(LIB.encoder(texts)[1])[:-1]]), texts):
        assert got.tolist() == reference(t) == lib.tolist()


def test_a_small_cache_changes_nothing():
    enc = chunks.ChunkEncoder(BPE.encode_keys, most=20)
    for _ in range(3):
        for t in TEXTS:
            ids, _ = enc([t or ""])
            assert ids.tolist() == reference(t or "")


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 20, 32])
def test_packing_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 4096, 10_001):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        assert token_packing.unpack(token_packing.pack(ids, bits), n, bits).tolist() == ids.tolist()
        counts = np.array([n // 2, 0, n - n // 2])
        shard = token_packing.Shard(token_packing.build_shard([None, 5, 9], counts, ids, bits, block=100))
        assert [shard.document(i).tolist() for i in range(3)] == [ids[: n // 2].tolist(), [], ids[n // 2 :].tolist()]
        for a, b in ((0, n), (n // 3, 2 * n // 3), (n, n)):
            assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        token_packing.pack(np.array([2**bits], np.uint64) if bits < 32 else np.array([-1]), bits)


def test_queries(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    four = {r["doc_id"]: r for r in op4_bpe_segment(spark, str(tmp_path)).collect()}
    three = {r["doc_id"]: r for r in op3_token_packing(spark, str(tmp_path)).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = reference(t or "")
        import hashlib

        assert four[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and four[i]["n_tokens"] == len(ids)
        assert four[i]["decoded_sha256"] == brute.sha(TOK.decode(ids, skip_special_tokens=False))
        assert (three[i]["start"], three[i]["n_tokens"], three[i]["ids_crc32"]) == (start, len(ids) + 1, brute.crc([*ids, 0]))
        start += len(ids) + 1
    path = token_packing.write_shards(empty, vocabulary())
    assert token_packing.read_digests(spark, path).count() == 0
    assert bpe_segment.encode_documents(empty, vocabulary()).count() == 0


def test_shards_of_few_tokens_and_null_ids(spark, docs):
    more = docs.union(spark.createDataFrame([(None, "no id", "en", "s", 5)], docs.schema))
    path = token_packing.write_shards(more, vocabulary(), end_id=0, shard_tokens=50)
    rows = sorted(token_packing.read_digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, *range(len(TEXTS))]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_encode_then_decode_frames(spark, docs):
    got = bpe_segment.encode_documents(docs.withColumnRenamed("lang", "ids"), vocabulary(), keep=("doc_id", "source"), decoded="back")
    rows = {r["doc_id"]: r for r in bpe_segment.decode_documents(got, vocabulary(), out="again").collect()}
    assert all(rows[i]["back"] == rows[i]["again"] == (t or "") for i, t in enumerate(TEXTS))


def test_ties_have_one_order_and_text_ids_are_refused(spark):
    rows = [(i % 3 if i % 5 else None, f"text {i * 7919 % 40}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def starts(d):
        path = token_packing.write_shards(d, vocabulary(), shard_tokens=40)
        return sorted(tuple(str(v) for v in r) for r in token_packing.read_digests(spark, path).collect())

    assert starts(df.coalesce(1)) == starts(df.repartition(1)) == starts(df.orderBy("text").coalesce(1))
    with pytest.raises(ValueError):
        token_packing.write_shards(df.selectExpr("concat('d', doc_id) doc_id", "text"), vocabulary())
