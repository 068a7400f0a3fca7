"""Evidence, rank, materiality, recommendation and telemetry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.operators import claim_scan
from kpiscope.operators import decision as d
from kpiscope.plans import model as m
from kpiscope.plans.registry import registry

QUERIES, SQL = {}, {}
query = registry(QUERIES, SQL)

_FRESH = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CURRENT' WHEN 'BUILDING' THEN 'LAGGING' WHEN 'MACHINERY' THEN 'STALE' ELSE 'ODD' END"
_FACTOR = "CASE fresh WHEN 'CURRENT' THEN 1.0 WHEN 'LAGGING' THEN 0.85 WHEN 'STALE' THEN 0.6 ELSE 0.5 END"


@query(f"""WITH e AS (SELECT c_custkey, {_FRESH} AS fresh, (c_custkey % 10) / 10.0 AS rel, (c_custkey % 7 + 1) / 8.3 AS cov, (c_custkey % 5) / 20.0 AS def, c_custkey % 90 AS n FROM customer)
SELECT c_custkey AS evidence_id, round(CAST(rel AS DOUBLE) * CAST(cov AS DOUBLE) * CAST({_FACTOR} AS DOUBLE) * greatest(0.0, 1 - 3 * CAST(def AS DOUBLE)) * sqrt(least(1.0, n / 60.0)), 4) AS weight FROM e""")
def evidence_weight(spark: SparkSession, sf: str) -> DataFrame:
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    fresh = F.when(seg == "AUTOMOBILE", "CURRENT").when(seg == "BUILDING", "LAGGING").when(seg == "MACHINERY", "STALE").otherwise("ODD")
    w = d.evidence_weight((k % 10) / 10.0, (k % 7 + 1) / 8.3, fresh, (k % 5) / 20.0, k % 90)
    return m.t(spark, sf, "customer").select(k.alias("evidence_id"), w.alias("weight"))


_STATUS = "['SUPPORTED_BY_INTERVENTION', 'SUPPORTED_BY_DESIGN', 'NOT_POINT_IDENTIFIED', 'ASSOCIATION_ONLY', 'INSUFFICIENT_EVIDENCE']"
_STRUCT = "['SUPPORTED', 'INCONCLUSIVE', 'NOT_TESTABLE', 'CONTRADICTED']"


@query(f"""WITH h AS (SELECT s_suppkey AS k, {_STATUS}[s_suppkey % 5 + 1] AS status, {_STRUCT}[s_suppkey % 4 + 1] AS structure, s_suppkey % 3 = 0 AS passed, (s_suppkey % 21 - 10) / 10.0 AS r FROM supplier),
c AS (SELECT k, 0.20 * (k % 100) / 100.0 + 0.20 * (CASE WHEN passed THEN least(1.0, abs(r) / 0.7) ELSE least(0.35, abs(r) / 2) END)
 + 0.20 * (CASE status WHEN 'SUPPORTED_BY_INTERVENTION' THEN 1.0 WHEN 'SUPPORTED_BY_DESIGN' THEN 0.9 WHEN 'NOT_POINT_IDENTIFIED' THEN 0.4 WHEN 'ASSOCIATION_ONLY' THEN 0.2 ELSE 0.0 END)
 + 0.15 * least(1.0, (k % 5) / 3.0) + 0.15 * (CASE structure WHEN 'SUPPORTED' THEN 1.0 WHEN 'INCONCLUSIVE' THEN 0.5 WHEN 'NOT_TESTABLE' THEN 0.25 ELSE 0.0 END) + 0.10 * ((k % 11) / 10.0) * greatest(0.4, 1 - 0.12 * (k % 6)) AS s FROM h)
SELECT k AS hypothesis, round(CAST(s AS DOUBLE), 4) AS score, CAST(row_number() OVER (ORDER BY round(CAST(s AS DOUBLE), 4) DESC, k) AS INTEGER) AS rank FROM c""")
def attention_rank(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, d.IDENTIFICATION_SCORE)), (k % 5 + 1).cast("int"))
    struct = F.element_at(F.array(*map(F.lit, d.STRUCTURE_SCORE)), (k % 4 + 1).cast("int"))
    parts = d.attention((k % 100) / 100.0, k % 3 == 0, (k % 21 - 10) / 10.0, status, k % 5, struct, (k % 11) / 10.0, k % 6)
    got = m.t(spark, sf, "supplier").select(k.alias("hypothesis"), parts["score"].alias("score"))
    return d.rank(got)


@query("""WITH r AS (SELECT o_orderkey, greatest(30 * o_totalprice / 4000000.0, (o_orderkey % 50) / 10.0 / 1.5) AS ratio FROM orders)
SELECT CASE WHEN ratio >= 4 THEN 'VERY_HIGH' WHEN ratio >= 2 THEN 'HIGH' WHEN ratio >= 1 THEN 'MODERATE' WHEN ratio >= 0.4 THEN 'LOW' ELSE 'NEGLIGIBLE' END AS impact_tier, count(*) AS n FROM r GROUP BY 1""")
def impact_tier(spark: SparkSession, sf: str) -> DataFrame:
    ratio = d.impact_ratio(F.col("o_totalprice"), (F.col("o_orderkey") % 50) / 10.0, F.lit(4e6), F.lit(1.5))
    return m.t(spark, sf, "orders").groupBy(d.impact_tier(ratio).alias("impact_tier")).agg(F.count("*").alias("n"))


#: The matrices as SQL of their own, so that a wrong table in the code shows.
_PRI = """SELECT s.i AS si, m.i AS mi, ['STRONG', 'MODERATE', 'WEAK', 'NONE'][s.i] AS statistical_tier, ['NEGLIGIBLE', 'LOW', 'MODERATE', 'HIGH', 'VERY_HIGH'][m.i] AS impact_tier,
 [['LOW', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], ['LOW', 'LOW', 'MEDIUM', 'HIGH', 'HIGH'], ['NONE', 'LOW', 'LOW', 'MEDIUM', 'HIGH'], ['NONE', 'NONE', 'LOW', 'MEDIUM', 'MEDIUM']][s.i][m.i] AS priority FROM range(1, 5) s(i), range(1, 6) m(i)"""
_ACT = """CASE WHEN statistical_tier = 'STRONG' AND priority IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN 'REMEDIATE' WHEN statistical_tier = 'MODERATE' AND priority = 'HIGH' THEN 'REMEDIATE_WITH_MONITORING'
 WHEN statistical_tier = 'WEAK' AND priority IN ('HIGH', 'MEDIUM') THEN 'INVESTIGATE' WHEN statistical_tier = 'NONE' AND priority = 'MEDIUM' THEN 'INVESTIGATE' ELSE 'MONITOR' END"""


@query(f"""WITH y AS ({_PRI}), x AS (SELECT statistical_tier, impact_tier, priority, {_ACT} AS action FROM y),
h AS (SELECT s_suppkey AS hypothesis, ['STRONG', 'MODERATE', 'WEAK', 'NONE'][s_suppkey % 4 + 1] AS statistical_tier, ['NEGLIGIBLE', 'LOW', 'MODERATE', 'HIGH', 'VERY_HIGH'][s_suppkey % 5 + 1] AS impact_tier FROM supplier)
SELECT hypothesis, statistical_tier, impact_tier, priority, action FROM h LEFT JOIN x USING (statistical_tier, impact_tier)""")
def priority_matrix(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    h = m.t(spark, sf, "supplier").select(k.alias("hypothesis"), F.element_at(F.array(*map(F.lit, d.PRIORITY)), (k % 4 + 1).cast("int")).alias("statistical_tier"), F.element_at(F.array(*map(F.lit, d.IMPACT_TIERS)), (k % 5 + 1).cast("int")).alias("impact_tier"))
    return d.prioritise(h).select("hypothesis", "statistical_tier", "impact_tier", "priority", "action")


_DRIVERS = ("on_time_dispatch_rate", "competitor_promo", "marketing_spend", "complaint_rate", "avg_selling_price")
_ACTIONS = ("REMEDIATE", "REMEDIATE_WITH_MONITORING", "INVESTIGATE", "MONITOR", "NO_ACTION", "OTHER")


def _hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """One hypothesis for each supplier, over all drivers, statuses and actions."""
    def pick(values, k):
        return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))

    k = F.col("s_suppkey")
    statuses = [*d.IDENTIFICATION_SCORE, "UNKNOWN"]
    return m.t(spark, sf, "supplier").select(
        F.format_string("h%06d", k).alias("hypothesis"), pick(_DRIVERS, k % 5).alias("driver"), pick(statuses, F.floor(k / 5) % 6).alias("status"), pick(_ACTIONS, F.floor(k / 2) % 6).alias("action"),
    )


_SCORED = """WITH b(playbook_id, driver, kind, impact, dc, ef, oc, irr, dn, resource, cfo) AS (VALUES
 ('PB-OPS-001', 'on_time_dispatch_rate', 'REMEDIATE', 0.72, 0.45, 0.30, 0.20, 0.15, 0.20, 'logistics_spend', true), ('PB-OPS-002', 'on_time_dispatch_rate', 'REMEDIATE', 0.34, 0.05, 0.20, 0.10, 0.05, 0.10, 'warehouse_labour', false),
 ('PB-CX-001', 'complaint_rate', 'REMEDIATE', 0.28, 0.12, 0.25, 0.10, 0.05, 0.15, 'cx_capacity', true), ('PB-COM-001', 'competitor_promo', 'INVESTIGATE', 0.55, 0.18, 0.15, 0.05, 0.02, 0.05, 'insights_budget', true),
 ('PB-MKT-001', 'marketing_spend', 'INVESTIGATE', 0.40, 0.10, 0.35, 0.05, 0.05, 0.05, 'data_platform', true), ('PB-MKT-002', 'marketing_spend', 'INVESTIGATE', 0.32, 0.08, 0.30, 0.05, 0.05, 0.05, 'data_platform', true),
 ('PB-PRC-001', 'avg_selling_price', 'INVESTIGATE', 0.38, 0.05, 0.20, 0.15, 0.10, 0.25, 'pricing_policy', true), ('PB-GOV-001', '*', 'MONITOR', 0.15, 0.01, 0.05, 0.02, 0.00, 0.02, 'analyst_time', true),
 ('PB-GOV-002', '*', 'MONITOR', 0.12, 0.01, 0.05, 0.02, 0.00, 0.02, 'analyst_time', true)),
h AS (SELECT printf('h%06d', s_suppkey) AS hypothesis, ['on_time_dispatch_rate', 'competitor_promo', 'marketing_spend', 'complaint_rate', 'avg_selling_price'][s_suppkey % 5 + 1] AS driver,
 ['SUPPORTED_BY_INTERVENTION', 'SUPPORTED_BY_DESIGN', 'NOT_POINT_IDENTIFIED', 'ASSOCIATION_ONLY', 'INSUFFICIENT_EVIDENCE', 'UNKNOWN'][s_suppkey // 5 % 6 + 1] AS status,
 ['REMEDIATE', 'REMEDIATE_WITH_MONITORING', 'INVESTIGATE', 'MONITOR', 'NO_ACTION', 'OTHER'][s_suppkey // 2 % 6 + 1] AS action FROM supplier),
a(action, kind) AS (VALUES ('REMEDIATE', 'REMEDIATE'), ('REMEDIATE_WITH_MONITORING', 'REMEDIATE'), ('REMEDIATE_WITH_MONITORING', 'MONITOR'), ('INVESTIGATE', 'INVESTIGATE'), ('INVESTIGATE', 'MONITOR'), ('MONITOR', 'MONITOR'), ('OTHER', 'MONITOR')),
j AS (SELECT hypothesis, playbook_id, resource, CASE WHEN irr < 0.1 THEN 'HIGH' WHEN irr < 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS reversibility,
 round(CAST(least(impact, CASE status WHEN 'SUPPORTED_BY_INTERVENTION' THEN 0.90 WHEN 'SUPPORTED_BY_DESIGN' THEN 0.85 WHEN 'NOT_POINT_IDENTIFIED' THEN 0.45 WHEN 'ASSOCIATION_ONLY' THEN 0.25 ELSE 0.15 END) AS DOUBLE) - CAST(dc + ef + oc AS DOUBLE) / 3 - CAST(irr * dn AS DOUBLE), 4) AS score
 FROM h JOIN a USING (action) JOIN b ON b.kind = a.kind AND (b.driver = h.driver OR b.driver = '*') WHERE cfo)"""


@query(_SCORED + " SELECT hypothesis, playbook_id, score, reversibility FROM j")
def playbook_score(spark: SparkSession, sf: str) -> DataFrame:
    return d.scored(_hypotheses(spark, sf), d.playbooks(spark), "cfo").select("hypothesis", "playbook_id", "score", "reversibility")


@query(_SCORED + """, r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, hypothesis, playbook_id) AS INTEGER) AS rank FROM j)
SELECT x.hypothesis, x.playbook_id, x.score, x.rank, coalesce((SELECT string_agg(DISTINCT y.playbook_id, ',') FROM r y WHERE y.rank <= 3 AND y.resource = x.resource AND y.playbook_id <> x.playbook_id), '') AS conflicts_with FROM r x WHERE x.rank <= 3""")
def recommendation_top(spark: SparkSession, sf: str) -> DataFrame:
    got = d.recommend(_hypotheses(spark, sf), d.playbooks(spark), "cfo")
    return got.select("hypothesis", "playbook_id", "score", "rank", F.array_join("conflicts_with", ",").alias("conflicts_with"))


@query("SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS resource, count(*) OVER (PARTITION BY s_nationkey) - 1 AS n_conflicts, count(*) OVER (PARTITION BY s_nationkey) > 1 AS conflict FROM supplier")
def conflict_flags(spark: SparkSession, sf: str) -> DataFrame:
    s = m.t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("resource"))
    return d.conflict_counts(s, "resource").select("s_suppkey", "resource", "n_conflicts", "conflict")


@query("""WITH h AS (SELECT o_orderkey, ['SUPPORTED_BY_INTERVENTION', 'SUPPORTED_BY_DESIGN', 'NOT_POINT_IDENTIFIED', 'ASSOCIATION_ONLY', 'INSUFFICIENT_EVIDENCE'][o_orderkey % 5 + 1] AS status, (o_orderkey % 13) / 100.0 AS p, o_orderkey % 3 AS failures FROM orders)
SELECT status, CASE WHEN status = 'SUPPORTED_BY_INTERVENTION' THEN 'STRONG' WHEN status = 'INSUFFICIENT_EVIDENCE' THEN 'NONE' WHEN status = 'SUPPORTED_BY_DESIGN' AND p < 0.05 AND failures = 0 THEN 'STRONG'
 WHEN status = 'SUPPORTED_BY_DESIGN' AND p < 0.10 AND failures <= 1 THEN 'MODERATE' ELSE 'WEAK' END AS tier, count(*) AS n FROM h GROUP BY ALL""")
def statistical_tier(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, d.IDENTIFICATION_SCORE)), (k % 5 + 1).cast("int"))
    h = m.t(spark, sf, "orders").select(status.alias("status"), ((k % 13) / 100.0).alias("p"), (k % 3).alias("failures"))
    return h.groupBy("status", d.statistical_tier(F.col("status"), F.col("p"), F.col("failures")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment AS classification, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN '[REDACTED]' ELSE c_name END AS value FROM customer")
def pii_redaction(spark: SparkSession, sf: str) -> DataFrame:
    ev = m.t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("classification"), F.col("c_name").alias("value"))
    return d.redact_evidence(ev, "value", "classification", ("AUTOMOBILE", "MACHINERY"))


_EV = """e AS (SELECT event_id AS evidence_id, CASE event_type WHEN 'purchase' THEN 'SUPPORT' WHEN 'error' THEN 'CONTRADICT' WHEN 'signup' THEN 'GAP' ELSE 'CONTEXT' END AS stance, value AS weight,
 CASE WHEN event_id % 4 = 0 THEN [] WHEN event_id % 4 = 1 THEN ['h1'] ELSE ['h2', 'h3'] END AS hypotheses, event_type AS source FROM events)"""


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("event_id") % 4
    stance = F.when(kind == "purchase", "SUPPORT").when(kind == "error", "CONTRADICT").when(kind == "signup", "GAP").otherwise("CONTEXT")
    hyp = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("h1"))).otherwise(F.array(F.lit("h2"), F.lit("h3")))
    return m.t(spark, sf, "events").select(F.col("event_id").alias("evidence_id"), stance.alias("stance"), F.col("value").alias("weight"), hyp.alias("hypotheses"), kind.alias("source"))


@query(f"""WITH {_EV}, x AS (SELECT *, row_number() OVER (PARTITION BY stance ORDER BY weight DESC, evidence_id) AS n FROM e WHERE list_contains(hypotheses, 'h1') OR len(hypotheses) = 0)
SELECT evidence_id, stance, weight FROM x WHERE stance IN ('CONTRADICT', 'GAP') OR (stance = 'SUPPORT' AND n <= 4) OR (stance = 'CONTEXT' AND n <= 6)""")
def stance_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return d.retrieve(_evidence(spark, sf), "h1").select("evidence_id", "stance", "weight")


@query(f"WITH {_EV} SELECT h AS hypothesis, count(DISTINCT source) AS n_sources FROM (SELECT unnest(hypotheses) AS h, source FROM e WHERE stance = 'SUPPORT') GROUP BY 1")
def corroboration(spark: SparkSession, sf: str) -> DataFrame:
    return d.corroboration(_evidence(spark, sf))


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY 1) SELECT event_type AS layer, s[1] AS min_ms, s[len(s) // 2 + 1] AS upper_median_ms, s[len(s)] AS max_ms, CAST(len(s) AS BIGINT) AS n FROM v""")
def telemetry_summary(spark: SparkSession, sf: str) -> DataFrame:
    from kpiscope.plans.telemetry import latency_summary

    return latency_summary(m.t(spark, sf, "events").select(F.col("event_type").alias("layer"), F.col("value").alias("ms")), "layer")


@query("""WITH c AS (SELECT s_nationkey AS nation, max(CASE WHEN s_acctbal < 0 THEN 3 WHEN s_acctbal < 2000 THEN 2 ELSE 1 END) AS top FROM supplier GROUP BY 1) SELECT nation, ['LOW', 'MEDIUM', 'HIGH'][top] AS severity FROM c""")
def severity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The worst severity of each nation's suppliers."""
    from kpiscope.operators.quality import worst_severity

    b = F.col("s_acctbal")
    seen = m.t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.when(b < 0, "HIGH").when(b < 2000, "MEDIUM").otherwise("LOW").alias("severity"))
    return worst_severity(seen, ("nation",))


@query("""SELECT event_type AS layer, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS ms, round(100 * sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / (SELECT sum(CAST(value AS DECIMAL(18,2)))::DOUBLE FROM events), 4) AS pct FROM events GROUP BY 1""")
def layer_time_split(spark: SparkSession, sf: str) -> DataFrame:
    from kpiscope.plans.telemetry import layer_split

    got = layer_split(m.t(spark, sf, "events").select(F.col("event_type").alias("layer"), F.col("value").cast("decimal(18,2)").alias("ms")))
    return got.select("layer", F.round("ms", 2).alias("ms"), F.round("pct", 4).alias("pct"))


@query("""WITH d AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'ERP-00' WHEN 1 THEN 'OPS-00' ELSE 'MKT-00' END AS defect_id, round(s_acctbal / 10000, 4) AS rate FROM supplier)
SELECT CASE split_part(defect_id, '-', 1) WHEN 'ERP' THEN 'SRC_ERP' WHEN 'OPS' THEN 'SRC_OPS' ELSE 'SRC_MKT' END AS source, max(rate) AS defect_rate FROM d GROUP BY 1""")
def worst_defect_rate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    rows = m.t(spark, sf, "supplier").select(F.when(k == 0, "ERP-00").when(k == 1, "OPS-00").otherwise("MKT-00").alias("defect_id"), F.round(F.col("s_acctbal") / 10000, 4).alias("rate"))
    return d.worst_defect_rate(rows, {"ERP": "SRC_ERP", "OPS": "SRC_OPS", "MKT": "SRC_MKT"})


_EXEMPT = ", ".join(f"'{x}'" for x in ("0", "1", "100", "12", "2", "24", "3", "30", "4", "5", "7", "95"))


@query(f"""WITH t AS (SELECT doc_id, n_chars, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, n_chars, unnest(regexp_extract_all(regexp_replace(text, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b', ' ', 'g'), '(?:^|[^\\w.+-])([-+]?\\d[\\d,]*(?:\\.\\d+)?)', 1)) AS raw FROM t),
n AS (SELECT doc_id, n_chars, regexp_replace(raw, '[+,-]', '', 'g') AS number FROM k),
v AS (SELECT doc_id, x.s * n_chars AS v FROM t, (SELECT unnest([1.0, 1e-5, 1e-7]) AS s) x), f AS (SELECT DISTINCT doc_id, form AS number FROM (SELECT doc_id, unnest([printf('%.0f', v), printf('%.1f', v), printf('%.2f', v), printf('%.3f', v), printf('%.4f', v)]) AS form FROM v)
 UNION SELECT doc_id, CASE WHEN contains(form, '.') THEN rtrim(rtrim(form, '0'), '.') ELSE form END FROM (SELECT doc_id, unnest([printf('%.1f', v), printf('%.2f', v), printf('%.3f', v), printf('%.4f', v)]) AS form FROM v)),
u AS (SELECT n.doc_id, count(*) AS unsourced FROM n LEFT JOIN f ON f.doc_id = n.doc_id AND f.number = n.number WHERE f.number IS NULL AND n.number NOT IN ({_EXEMPT}) GROUP BY n.doc_id),
b AS (SELECT DISTINCT array_to_string(list_slice(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 1, 3), ' ') AS phrase FROM benchmark WHERE len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) >= 3),
s AS (SELECT doc_id, no, regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT doc_id, unnest(parts) AS sentence, unnest(generate_series(1, len(parts))) AS no FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM t))),
g AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS phrase FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM s WHERE len(w) >= 3)),
p AS (SELECT doc_id, count(*) AS said FROM g JOIN b ON b.phrase = g.phrase GROUP BY doc_id)
SELECT t.doc_id, coalesce(unsourced, 0) AS unsourced, coalesce(said, 0) AS said FROM t LEFT JOIN u ON u.doc_id = t.doc_id LEFT JOIN p ON p.doc_id = t.doc_id WHERE unsourced IS NOT NULL OR said IS NOT NULL""")
def claim_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with numerals other than their length, or with the opening three words of a benchmark item in a sentence."""
    docs = m.t(spark, sf, "documents").select("doc_id", "text", "n_chars")
    first = claim_scan.words(F.col("text"))
    opening = m.t(spark, sf, "benchmark").where(F.size(first) >= 3).select(F.array_join(F.slice(first, 1, 3), " ").alias("phrase"))
    numbers = claim_scan.unsourced(docs, docs.select("doc_id", "n_chars"), "doc_id", "text", "n_chars").groupBy("id").agg(F.count("*").alias("unsourced"))
    said = claim_scan.phrase_hits(docs, opening, "doc_id", "text", "phrase").groupBy("id").agg(F.sum("n").alias("said"))
    got = numbers.join(said, "id", "full").select(F.col("id").alias("doc_id"), F.coalesce("unsourced", F.lit(0)).alias("unsourced"), F.coalesce("said", F.lit(0)).alias("said"))
    return got
