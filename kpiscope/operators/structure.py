"""Screen of declared edges by partial correlation; it can contradict an edge, never add one."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiscope.functions import tails
from kpiscope.functions.stats import t_sf2
from kpiscope.operators import regress
from kpiscope.operators.graph import Dag

NULL_BAND, ALPHA, WINDOWS, AGREEMENT = 0.15, 0.05, 12, 0.75


def partial_corr_one(r_xy: Column, r_xz: Column, r_yz: Column) -> Column:
    """Partial correlation given one variable, from pairwise correlations."""
    return F.try_divide(r_xy - r_xz * r_yz, F.sqrt((1 - r_xz * r_xz) * (1 - r_yz * r_yz)))


def partial_correlation(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> dict[str, float | None]:
    """Both residualised on z (with constant and trend); interval by Fisher's transform."""
    keep = np.isfinite(x) & np.isfinite(y) & np.isfinite(z).all(1)
    n = int(keep.sum())
    none = {"r": None, "p": None, "low": None, "high": None, "n": n}
    if n < 20:
        return none
    d = np.column_stack([np.ones(n), np.flatnonzero(keep), z[keep]])
    res = [v[keep] - d @ np.linalg.lstsq(d, v[keep], rcond=None)[0] for v in (x, y)]
    if min(r.std() for r in res) < 1e-12:
        return none
    r = float(np.corrcoef(*res)[0, 1])
    dof = n - d.shape[1] - 1
    if dof <= 3 or abs(r) >= 0.999:
        return none | {"r": r}
    half = 1.959963984540054 / math.sqrt(dof - 1)
    mid = math.atanh(r)
    t = r * math.sqrt(dof / (1 - r * r))
    return {"r": r, "p": t_sf2(t, dof), "low": math.tanh(mid - half), "high": math.tanh(mid + half), "n": n}


def edge_verdict(c: Mapping[str, float | None]) -> str:
    if c["p"] is None:
        return "NOT_TESTABLE"
    if c["p"] < ALPHA:
        return "SUPPORTED"
    if c["low"] > -NULL_BAND and c["high"] < NULL_BAND:
        return "CONTRADICTED"
    return "INCONCLUSIVE"


def screen(panel: DataFrame, dag: Dag, order: str = "date") -> DataFrame:
    """(source, target, verdict, r, p, agreement) for each declared edge between known columns.

    The panel (a row a day) stays a table: each row goes to the edges and windows it belongs to, one aggregation sums the
    cross-products of each, and both ends are freed of constant, trend and conditions by the Schur complement of the swept
    block. Only the number of days and the columns' means come to the driver.
    """
    spark: SparkSession = panel.sparkSession
    have = [c for c in panel.columns if c in dag.nodes]
    edges = [(a, b, conditioning(dag, a, b, have)) for a, b in sorted(dag.edges) if a in have and b in have]
    if not edges:
        return spark.createDataFrame([], "source string, target string, verdict string, r double, p double, agreement double")
    about = panel.agg(F.count("*").alias("n"), *[F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))).alias(f"m_{c}") for c in have]).first()
    n = about["n"]
    size = max(30, int(0.7 * n))
    starts = [int(k * (max(0, n - size) / (WINDOWS - 1))) for k in range(WINDOWS)]
    bounds = [(-1, 0, n)] + [(w, at, at + size) for w, at in enumerate(starts)]
    k = 2 + max(len(z) for _, _, z in edges)  # constant, trend, conditions; missing ones are columns of zeros

    def centred(c: str) -> Column:
        return F.col(f"`{c}`").cast("double") - F.lit(about[f"m_{c}"] or 0.0)

    def row_of(a: str, b: str, z: Sequence[str]) -> Column:
        cols = [F.lit(1.0), F.col("_i") - n / 2, *map(centred, z), *[F.lit(0.0)] * (k - 2 - len(z)), centred(a), centred(b)]
        return F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(len(z)).alias("_z"), F.array(*cols).alias("_x"))

    rows = panel.select(*have, (F.row_number().over(Window.orderBy(order)) - 1).alias("_i"))  # a row a day
    each = rows.select("_i", F.explode(F.array(*[row_of(*e) for e in edges])).alias("e")).select("_i", "e.*")
    each = each.where("NOT exists(_x, v -> v IS NULL OR isnan(v))")
    windows = ", ".join(f"({w}, {a}, {z})" for w, a, z in bounds)
    each = each.withColumn("w", F.explode(F.expr(f"transform(filter(array({windows}), b -> _i >= b.col2 AND _i < b.col3), b -> b.col1)")))
    pairs = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    sums = each.groupBy("source", "target", "w").agg(*map(F.expr, ["count(*) AS n", "first(_z) AS _z", *[f"sum(_x[{i}] * _x[{j}]) AS _{i}_{j}" for i, j in pairs]]))
    scale = "array(" + ", ".join(f"if(_{i}_{i} > 0, sqrt(_{i}_{i}), 1D)" for i in range(k)) + ")"
    like = "transform({m}, (line, r) -> transform(line, (v, c) -> v / (_size[r] * _size[c])))"
    s = sums.withColumn("_size", F.expr(scale))
    s = s.withColumn("_inv", F.expr(like.format(m=regress.swept(like.format(m=regress._symmetric(k)), k))))
    s = s.withColumns({f"_d{e}": F.expr("array(" + ", ".join(f"_{i}_{k + e}" for i in range(k)) + ")") for e in (0, 1)})

    def left(a: int, b: int) -> str:
        return f"(_{k + a}_{k + b} - {regress.dot(f'_d{a}', regress.times('_inv', f'_d{b}'))})"

    s = s.withColumns({"_xx": F.expr(left(0, 0)), "_xy": F.expr(left(0, 1)), "_yy": F.expr(left(1, 1)), "_dof": F.expr("n - 2 - _z - 1")})
    flat = f"n < 20 OR least(_xx - 1e-10 * _{k}_{k}, _yy - 1e-10 * _{k + 1}_{k + 1}) <= 0 OR sqrt(least(_xx, _yy) / n) < 1e-12"
    s = s.withColumn("r", F.expr(f"if({flat}, NULL, _xy / sqrt(_xx * _yy))"))
    told = "r IS NOT NULL AND _dof > 3 AND abs(r) < 0.999"
    s = s.withColumn("_t", F.expr(f"if({told}, r * sqrt(_dof / (1 - r * r)), NULL)")).withColumn("_half", F.expr(f"if({told}, 1.959963984540054D / sqrt(_dof - 1), NULL)"))
    s = s.withColumn("p", tails.t_sf2("_t", "_dof"))
    null_effect = f"tanh(atanh(r) - _half) > -{NULL_BAND} AND tanh(atanh(r) + _half) < {NULL_BAND}"
    s = s.withColumn("v", F.expr(f"CASE WHEN p IS NULL THEN 'NOT_TESTABLE' WHEN p < {ALPHA} THEN 'SUPPORTED' WHEN {null_effect} THEN 'CONTRADICTED' ELSE 'INCONCLUSIVE' END"))
    declared = spark.createDataFrame([(a, b) for a, b, _ in edges], "source string, target string")
    whole = s.where("w = -1").select("source", "target", F.col("v").alias("whole"), "r", "p")
    base = declared.join(whole, ["source", "target"], "left").withColumn("whole", F.coalesce("whole", F.lit("NOT_TESTABLE")))
    parts = s.where("w >= 0").groupBy("source", "target").agg(F.collect_list("v").alias("vs"))
    got = base.join(parts, ["source", "target"], "left").withColumn("vs", F.coalesce("vs", F.array().cast("array<string>")))
    # A window without any complete row is not testable.
    agree = F.expr(f"(size(filter(vs, v -> v = whole)) + if(whole = 'NOT_TESTABLE', {WINDOWS} - size(vs), 0)) / {WINDOWS}D")
    got = got.withColumn("agreement", agree)
    verdict = F.when((F.col("agreement") >= AGREEMENT) | (F.col("whole") == "NOT_TESTABLE"), F.col("whole")).otherwise("INCONCLUSIVE")
    return got.select("source", "target", verdict.alias("verdict"), "r", "p", "agreement")


def conditioning(dag: Dag, source: str, target: str, have: Sequence[str]) -> list[str]:
    """The target's other parents that are no descendants of the source, where known."""
    return sorted((dag.parents(target) - {source} - dag.descendants({source})) & set(have))


