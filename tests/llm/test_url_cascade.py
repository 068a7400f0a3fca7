import pytest
from kpiscope.llm import url_cascade
from kpiscope.llm.queries import BLOCKED_SITES, URL_RULES
from kpiscope.llm.url_cascade import Rule, build_cascade, judge_urls
from pyspark.sql import functions as F

URLS = [
    None, "", "no scheme", "http://", "https://www.Example.COM/en/a?x=1", "http://a.example.com/en/", "http://example.com/en", "http://x.net/es/1#t",
    "http://net/fr/", "http://example.com", "http://spam-farm.example.org/a", "http://www.spam-farm.example.org?q", "http://a://b.com/c", "ftp://host.com/é/ü", "http://example.com/en/\nx",
]


def plain(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(str(r)), default=None)
    listed = any(host == b or host.endswith("." + b) for b in BLOCKED_SITES)
    return host, path, str(best) if best else None, best.verdict if best else "block" if listed else "allow"


def test_against_plain(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, URL_RULES, BLOCKED_SITES).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS * 2)}


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES, BLOCKED_SITES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(30000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = build_cascade(universe.where("hash(key) % 10 = 0"), universe)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.contains(F.col("key")) != (F.expr("hash(key) % 10 = 0")))
    assert wrong.count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    plan = judge_urls(pages, [Rule("block", "com", "/x")], ["b.org"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_long_lists_are_split_by_key(spark, monkeypatch):
    """With few keys to a literal, and lists from tables, verdicts are the same."""
    monkeypatch.setattr(url_cascade, "MAX_KEYS", 3)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in URL_RULES] + [("block", None, "/x")], "verdict string, host string, path string")
    sites = spark.createDataFrame([(h,) for h in BLOCKED_SITES] + [(None,)], "host string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rules, sites).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS * 2)}
    universe = spark.range(90).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = build_cascade(universe.where("id % 3 = 0"), universe)
    assert len(cascade.levels[0].parts) == 10
    small = spark.range(90).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 3 == 0).alias("want"))
    assert small.where(cascade.contains(F.col("key")) != F.col("want")).count() == 0
    with pytest.raises(ValueError):
        judge_urls(pages, rules.union(rules), sites)


def test_two_hundred_thousand_hosts(spark):
    """A long list as it is; the plan's expressions do not grow with it but for the literals."""
    host = lambda n: F.concat(F.lit("h"), (F.col("id") * n).cast("string"), F.lit(".example.org"))
    sites = spark.range(200_000).select(host(3).alias("host"))
    pages = spark.range(400_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www."), host(1), F.lit("/x")).alias("url"))
    got = judge_urls(pages, [Rule("allow", "h6.example.org", "/")], sites)
    want = (F.col("page_id") % 3 == 0) & (F.col("page_id") < 600_000) & (F.col("page_id") != 6)
    wrong = got.where((F.col("verdict") == "block") != want)
    assert wrong.count() == 0 and got.where("verdict = 'block'").count() == 133_333


def test_a_larger_corpus_takes_more_bits_not_more_keys():
    assert url_cascade.first_bits(5, 5) == url_cascade.LATER_BITS < url_cascade.first_bits(5, 5 * 10**12) <= 60
    assert url_cascade.first_bits(10**6, 10**12) <= 30
