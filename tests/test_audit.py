import datetime as dt

from kpiscope.operators import claim_scan
from kpiscope.streaming.audit import EVENTS, AuditTable


def test_a_batch_delivered_again_adds_nothing(spark, tmp_path):
    table = AuditTable(f"file://{tmp_path}/audit")
    assert table.events(spark).count() == 0 and table.tail(spark).count() == 0
    at = dt.datetime(2026, 1, 1)
    one = spark.createDataFrame([(at, "r1", "cfo", "analyse", True, "OK", ""), (at, "r2", "ops", "analyse", False, "ROW_SCOPE", "")], EVENTS)
    two = spark.createDataFrame([(at + dt.timedelta(hours=1), "r1", "cfo", "render", True, "OK", None)], EVENTS)
    assert table.append(one, 0) and table.append(two, 1)
    assert not table.append(one, 0) and not table.append(two.union(two), 1)
    assert table.events(spark).count() == 3
    assert [r.action for r in table.by_request(spark, "r1").collect()] == ["analyse", "render"]
    assert [r.code for r in table.denials(spark).collect()] == ["ROW_SCOPE"]
    assert [r.action for r in table.tail(spark, 1).collect()] == ["render"]
    # A batch that broke off before its manifest entry is not read, and is replaced when it comes again.
    one.union(one).write.parquet(f"file://{tmp_path}/audit/rows/batch=2")
    assert table.events(spark).count() == 3
    assert table.append(two, 2) and table.events(spark).count() == 4


def test_texts_against_facts(spark):
    texts = spark.createDataFrame([(1, "It fell by 12.50 on 2026-08-01. Of 1,234 units 95 stayed."), (2, "The root cause, root cause! Or\nroot\ncause 7 of 8."), (3, None), (4, "v2.5 x-3 -6.25")], "id long, t string")
    facts = spark.createDataFrame([(1, 12.5), (1, 1234.0), (4, -6.25), (2, None)], "id long, v double")
    got = sorted((r.id, r.number) for r in claim_scan.unsourced(texts, facts, "id", "t", "v").collect())
    assert got == [(2, "8")]
    assert sorted((r.id, r.number) for r in claim_scan.unsourced(texts, facts.where("id = 1"), "id", "t", "v", own=False).collect()) == [(2, "8"), (4, "6.25")]
    phrases = spark.createDataFrame([("root cause",), ("Fell",), ("",)], "p string")
    hits = sorted((r.id, r.phrase, r.sentence, r.n) for r in claim_scan.phrase_hits(texts, phrases, "id", "t", "p").collect())
    assert hits == [(1, "fell", 0, 1), (2, "root cause", 0, 2), (2, "root cause", 1, 1)]
    assert claim_scan.phrase_hits(texts, phrases.where("false"), "id", "t", "p").count() == 0
