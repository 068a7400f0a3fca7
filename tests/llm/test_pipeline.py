import corpus_pipeline
import pytest
from kpiscope.llm import bpe_segment, pii_crf, quality_cnn, simhash_tiles, suffix_decontam
from kpiscope.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp(f"stage{k}") / "t")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_decisions(spark, steps):
    docs, good, single, clean, masked, tokens = steps
    assert all(s.columns == docs.columns for s in (good, single, clean, masked))
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(i in ids[1] for i, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    near = simhash_tiles.near_duplicates(good).collect()
    assert {r["component_id"] for r in near} == ids[2]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert suffix_decontam.report(clean, bench).where("contaminated").count() == 0
    assert all(not b for _, b in ((r["doc_id"], pii_crf.base_spans(r["text"] or "")) for r in masked.collect()))


def test_tokens_decode_to_the_texts(steps):
    masked, tokens = steps[4], steps[5]
    texts = {r["doc_id"]: r["text"] or "" for r in masked.collect()}
    bpe = bpe_segment.load(vocabulary())
    for r in tokens.collect():
        assert r["decoded"] == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert bpe.encode([r["decoded"]])[0].tolist() == r["ids"]


def test_untouched_documents_stay_as_they_are(steps):
    docs = {r["doc_id"]: r["text"] for r in steps[0].collect()}
    field = pii_crf.default_field()
    for r in steps[4].collect():
        (_, spans), = pii_crf.find([docs[r["doc_id"]]], field)
        if not spans and r["text"] != docs[r["doc_id"]]:
            assert len(r["text"]) < len(docs[r["doc_id"]])  # a benchmark passage was cut


def test_threshold_is_the_query_s():
    assert corpus_pipeline.QUALITY_THRESHOLD == 0.3 and quality_cnn.CHUNK > quality_cnn.STEP


def odd(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, _score double, `a.b` string, raw string, c0 string")


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, null ids and columns with clashing names."""
    texts = [None, "", "one two", "Clean words about rivers and hills. " * 4000, "mail a@b.org or +1 202 555 0143 now", None]
    rows = [(i, t, 0.5, "x", None, "c") for i, t in enumerate(texts)] + [(4, texts[4], 0.5, "x", None, "c"), (None, "a row without an id", None, None, None, None)]
    docs = odd(spark, rows)
    by = dict(corpus_pipeline.STAGES)
    single = by["near_dedup"](spark, docs, SF)
    assert single.columns == docs.columns
    # Null and empty texts are one group of which 0 stays; the repeated row stays twice.
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in single.collect()) == [-1, 0, 2, 3, 4, 4]
    clean = by["decontaminate"](spark, docs, SF)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    masked = by["personal_data"](spark, docs, SF)
    got = [r["text"] for r in masked.collect()]
    assert masked.columns == docs.columns and [t for t in got if t is None] == [None, None] and not any("@" in (t or "") for t in got)
    assert texts[3] in got and len(got) == len(rows)
    good = by["quality"](spark, docs, SF)
    assert good.columns == docs.columns and good.exceptAll(docs).count() == 0
    repeats = good.where("doc_id = 4").count()
    assert repeats in (0, 2)
    tokens = by["tokens"](spark, docs, SF).collect()
    assert len(tokens) == len(rows) and sorted(r["decoded"] for r in tokens) == sorted(t or "" for _, t, *_ in rows)


def test_stages_take_an_empty_table(spark):
    docs = odd(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0
        if name != "tokens":
            assert got.columns == docs.columns


def test_the_whole_run_against_brute_force(spark, steps):
    """``run`` itself: its documents are those that plain versions of all decisions leave, with the same texts' tokens."""
    import re

    from tokenizers import Tokenizer

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in steps[0].collect()}
    network = quality_cnn.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    good = sorted(r["doc_id"] for r in quality_cnn.score(steps[0].select("doc_id", "text"), network).collect() if r["score"] >= 0.3)

    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, root = {i: shingles(docs[i]) for i in good}, {i: i for i in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    single = [i for i in good if find(i) == i]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: set = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(lower(r["text"]))
        windows |= {tuple(w[i : i + 10]) for i in range(max(0, len(w) - 9))} | ({tuple(w)} if 0 < len(w) < 10 else set())
    kept = []
    for i in single:
        w, hit = word.findall(lower(docs[i])), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit |= set(range(p, p + size))
        if 2 * len(hit) <= len(w):
            kept.append(i)
    assert sorted(got) == kept
    tok = Tokenizer.from_file(vocabulary())
    assert all(r["ids"] == tok.encode(r["decoded"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in got.values())
    for r in got.values():
        w = word.findall(lower(r["decoded"]))
        assert not any(tuple(w[p : p + 10]) in windows for p in range(len(w) - 9)) and not pii_crf.base_spans(r["decoded"])
