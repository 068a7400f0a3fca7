"""Evidence rows: typed facts from the analysis, each with a stable id, stance and weight."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.functions.scalars import hash_id
from kpiscope.operators.decision import evidence_weight

COLUMNS = ("evidence_id", "evidence_type", "stance", "source", "hypotheses", "statement", "value", "classification", "weight")


def rows(df: DataFrame, kind: str, stance: Column | str, source: str, hypotheses: Column, statement: Column, value: Column, classification: str = "INTERNAL",
         reliability: float = 0.9, coverage: Column | None = None, freshness: Column | None = None, defect_rate: Column | None = None, n: Column | None = None) -> DataFrame:
    """Evidence rows of one kind from a table of facts."""
    stance_col = F.lit(stance) if isinstance(stance, str) else stance
    lit = F.lit
    weight = evidence_weight(lit(reliability), coverage if coverage is not None else lit(1.0), freshness if freshness is not None else lit("CURRENT"),
                             defect_rate if defect_rate is not None else lit(0.0), n if n is not None else lit(60))
    return df.select(
        hash_id(8, lit(kind), lit(source), statement, value.cast("string")).alias("evidence_id"), lit(kind).alias("evidence_type"), stance_col.alias("stance"),
        lit(source).alias("source"), hypotheses.alias("hypotheses"), statement.alias("statement"), value.cast("double").alias("value"),
        lit(classification).alias("classification"), weight.alias("weight"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _none() -> Column:
    return F.array().cast("array<string>")


def movement(summary: DataFrame) -> DataFrame:
    """One row a KPI: (kpi, pct, n)."""
    return rows(summary, "KPI_MOVEMENT", "CONTEXT", "SRC_ERP", _none(), F.format_string("%s moved by %.2f %%", "kpi", "pct"), F.col("pct"), n=F.col("n"))


def decomposition(terms: DataFrame) -> DataFrame:
    """One row a term: (term, pp)."""
    return rows(terms, "DECOMPOSITION", "CONTEXT", "SRC_ERP", _none(), F.format_string("%s contributes %.4f points", "term", "pp"), F.col("pp"))


def causal(estimates: DataFrame) -> DataFrame:
    """(hypothesis, source, design, estimate, p): a clear estimate supports, an unclear one is context."""
    stance = F.when(F.col("p") < 0.05, "SUPPORT").otherwise("CONTEXT")
    return rows(estimates, "CAUSAL_ESTIMATE", stance, "SRC_OPS", F.array("hypothesis"), F.format_string("%s estimate for %s", "design", "hypothesis"), F.col("estimate"))


def gaps(freshness: DataFrame, coverage: DataFrame, defects: DataFrame) -> DataFrame:
    """Stale sources, variables of little coverage, and severe defects."""
    return union([
        rows(freshness.where("status in ('STALE', 'MISSING')"), "DATA_GAP", "GAP", "META", _none(), F.concat(F.lit("stale source "), F.col("source")), F.lit(1.0)),
        rows(coverage.where("status in ('SPARSE', 'ABSENT')"), "DATA_GAP", "GAP", "META", _none(), F.concat(F.lit("little coverage of "), F.col("variable")), F.col("pct")),
        rows(defects.where("severity = 'HIGH' and affected > 0"), "DATA_GAP", "GAP", "META", _none(), F.concat(F.lit("severe defect "), F.col("defect_id")), F.col("rate")),
    ])


def operational(region_days: DataFrame, base: tuple[dt.date, dt.date], focus: tuple[dt.date, dt.date], treated: str) -> DataFrame:
    """Regional rules: on-time dispatch down by over two points, or complaints up by over ten
    percent, support the fulfilment hypothesis; a like fall in an untreated region contradicts."""
    d = F.col("date")
    b, f = d.between(*map(F.lit, base)), d.between(*map(F.lit, focus))

    def share(num: str, den: str, when: Column) -> Column:
        return F.try_divide(F.sum(F.when(when, F.col(num))), F.sum(F.when(when, F.col(den))))

    got = region_days.groupBy("region").agg(
        (100 * (share("dispatched_within_sla", "dispatch_attempts", f) - share("dispatched_within_sla", "dispatch_attempts", b))).alias("otd_pp"),
        (100 * (F.try_divide(share("complaint_tickets", "shipped_orders", f), share("complaint_tickets", "shipped_orders", b)) - 1)).alias("complaints_pct"),
        F.count("*").alias("n"),
    )
    mine = F.col("region") == treated
    hyp = F.array(F.lit("fulfilment"))
    return union([
        rows(got.where(F.col("otd_pp") < -2), "OPERATIONAL_METRIC", F.when(mine, "SUPPORT").otherwise("CONTRADICT"), "SRC_OPS", hyp, F.format_string("on-time dispatch in %s moved by %.2f points", "region", "otd_pp"), F.col("otd_pp"), n=F.col("n")),
        rows(got.where(mine & (F.col("complaints_pct") > 10)), "TICKET_CLUSTER", "SUPPORT", "SRC_CX", hyp, F.format_string("complaints in %s moved by %.1f %%", "region", "complaints_pct"), F.col("complaints_pct"), n=F.col("n")),
    ])
