from dataclasses import replace

from kpiscope.llm import blob_ledger as b
from kpiscope.llm.queries import op10_blob_ledger

from . import brute
from .conftest import TEXTS


def test_query_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = op10_blob_ledger(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString()
    got = {r["doc_id"]: r for r in df.collect()}
    for i, t in enumerate(TEXTS):
        want = brute.secrets(t or "")
        assert got[i]["base_sha256"] == brute.sha(brute.joined(want)), t
        assert got[i]["spans"] == brute.joined(want)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]


def test_only_unseen_pairs_are_scanned(spark, docs, empty, tmp_path):
    path = f"{tmp_path}/ledger"
    first = docs.where("doc_id < 6")
    b.update_ledger(first, path)
    n = b.read_ledger(spark, path).count()
    assert n == first.selectExpr("coalesce(text, '') as t").distinct().count()
    b.update_ledger(first, path)
    assert b.read_ledger(spark, path).count() == n
    assert b.scan_unseen(first, b.read_ledger(spark, path)).count() == 0
    changed = (replace(b.RULES[0], version=2), *b.RULES[1:])
    again = b.scan_unseen(first, b.read_ledger(spark, path), changed).collect()
    assert len(again) == n and {tuple(r["rules"]) for r in again} == {("assign@2",)}
    b.update_ledger(first, path, changed)
    b.update_ledger(docs, path, changed)
    got = {r["doc_id"]: b_spans(r) for r in b.findings(docs, b.read_ledger(spark, path), changed).collect()}
    assert got == {i: brute.secrets(t or "") for i, t in enumerate(TEXTS)}
    assert b.findings(empty, b.read_ledger(spark, path)).count() == 0 and b.scan_unseen(empty, None).count() == 0


def b_spans(row):
    return [(s["kind"], s["start"], s["end"]) for s in row["spans"]]
