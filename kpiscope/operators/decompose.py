"""Exact decomposition of a flow's movement into volume, mix, price, entry and exit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.scalars import safe_ratio
from kpiscope.operators.metrics import FLOW, ContractViolation, Kpi

TERMS = ("volume", "mix", "price", "entry", "exit")


def cell_averages(fact: DataFrame, dims: Sequence[str], value: Column, quantity: Column, base: Column, focus: Column, date: str = "date") -> DataFrame:
    """Per cell: v0, q0, v1, q1, averages a day of the two windows (days that have any row).

    The facts are aggregated to day cells once; sums by cell and the numbers of days both come
    from these (the plan reuses their exchange), so joins below run once.
    """
    inside = fact.where(base | focus).withColumns({"_base": base, "_focus": focus, "_v": value, "_q": quantity})
    cells = inside.groupBy(date, "_base", "_focus", *dims).agg(F.sum("_v").alias("_v"), F.sum("_q").alias("_q"))
    days = cells.agg(F.count_distinct(F.when(F.col("_base"), F.col(date))).alias("d0"), F.count_distinct(F.when(F.col("_focus"), F.col(date))).alias("d1"))
    sums = cells.groupBy(*dims).agg(*[F.sum(F.when(F.col(w), F.col(x))).alias(n) for n, w, x in (("v0", "_base", "_v"), ("q0", "_base", "_q"), ("v1", "_focus", "_v"), ("q1", "_focus", "_q"))])
    got = sums.join(F.broadcast(days), how="cross")

    def mean(c: str, d: str) -> Column:
        return (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.greatest(F.col(d), F.lit(1))).alias(c)

    return got.select(*dims, mean("v0", "d0"), mean("q0", "d0"), mean("v1", "d1"), mean("q1", "d1"))


def join_windows(before: DataFrame, after: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Cells of two windows that were computed apart; cells of one window only count as zero in
    the other. Both have the columns v and q."""
    a = before.select(*dims, F.col("v").alias("v0"), F.col("q").alias("q0"))
    b = after.select(*dims, F.col("v").alias("v1"), F.col("q").alias("q1"))
    return a.join(b, list(dims), "full_outer").fillna(0.0, ["v0", "q0", "v1", "q1"])


def _common() -> Column:
    return (F.col("q0") > 0) & (F.col("q1") > 0)


def pvm_terms(cells: DataFrame) -> DataFrame:
    """One row: base, total, the five terms, and each term in points of the base and as a share
    of the total. Cells with sales in one window only are entry or exit."""
    c = _common()
    sums = cells.agg(
        F.sum("v0").alias("base"), F.sum("v1").alias("focus"),
        F.sum(F.when(c, F.col("v0"))).alias("cv0"), F.sum(F.when(c, F.col("q0"))).alias("cq0"), F.sum(F.when(c, F.col("q1"))).alias("cq1"),
        F.sum(F.when(c, F.col("q1") * F.col("v0") / F.col("q0"))).alias("at_old"), F.sum(F.when(c, F.col("v1"))).alias("cv1"),
        F.coalesce(F.sum(F.when((F.col("q0") <= 0) & (F.col("q1") > 0), F.col("v1"))), F.lit(0.0)).alias("entry"),
        F.coalesce(F.sum(F.when((F.col("q1") <= 0) & (F.col("q0") > 0), F.col("v0"))), F.lit(0.0)).alias("exit_v0"),
        # Values without quantity on one side or both belong to no other term.
        F.coalesce(F.sum(F.when(~c & (F.col("q0") <= 0), F.col("v0"))), F.lit(0.0)).alias("odd0"),
        F.coalesce(F.sum(F.when(~c & (F.col("q1") <= 0), F.col("v1"))), F.lit(0.0)).alias("odd1"),
    )
    zero = F.lit(0.0)
    cv0, cq0, cq1, old, cv1 = (F.coalesce(F.col(x), zero) for x in ("cv0", "cq0", "cq1", "at_old", "cv1"))
    p0 = F.coalesce(F.try_divide(cv0, cq0), zero)
    got = sums.select(
        "base", "focus", (F.col("focus") - F.col("base")).alias("total"), ((cq1 - cq0) * p0).alias("volume"), (old - cq1 * p0).alias("mix"),
        (cv1 - old).alias("price"), F.col("entry"), (F.lit(0.0) - F.col("exit_v0")).alias("exit"), (F.col("odd1") - F.col("odd0")).alias("unpriced"),
    )
    out = got
    for t in TERMS:
        out = out.withColumn(f"{t}_pp", 100 * F.try_divide(F.col(t), F.col("base"))).withColumn(f"{t}_share", 100 * F.try_divide(F.col(t), F.col("total")))
    return out


def closure_gap(terms: DataFrame) -> DataFrame:
    parts = F.col("unpriced")
    for t in TERMS:
        parts = parts + F.col(t)
    return terms.withColumn("gap", F.abs(parts - F.col("total"))).withColumn("closes", F.col("gap") <= F.greatest(F.lit(1e-6), F.abs("total") * 1e-9))


def decompose(fact: DataFrame, kpi: Kpi, dims: Sequence[str], value: Column, quantity: Column, base: tuple[dt.date, dt.date], focus: tuple[dt.date, dt.date]) -> DataFrame:
    """Checked entry point: flows only, over at least one cell dimension."""
    if kpi.time_aggregation != FLOW:
        raise ContractViolation(f"{kpi.kpi_id} is no flow and has no price, volume and mix")
    if not dims:
        raise ContractViolation("a decomposition needs a cell dimension")
    d = F.col("date")
    cells = cell_averages(fact, dims, value, quantity, d.between(*map(F.lit, base)), d.between(*map(F.lit, focus)))
    return closure_gap(pvm_terms(cells))


def pvm_cells(cells: DataFrame, dims: Sequence[str], top: int | None = 8, by: str = "contribution") -> DataFrame:
    """Each common cell's volume change in percent, mix and price terms; the ``top`` largest by
    contribution, or the lowest by change."""
    c = _common()
    w = Window.partitionBy()
    sums = cells.where(c).withColumns({"all_q0": F.sum("q0").over(w), "all_q1": F.sum("q1").over(w)})
    p0, p1 = F.col("v0") / F.col("q0"), F.col("v1") / F.col("q1")
    got = sums.select(
        *dims, (F.col("v1") - F.col("v0")).alias("contribution"), (100 * safe_ratio(F.col("q1") - F.col("q0"), F.col("q0"))).alias("volume_pct"),
        (F.col("all_q1") * p0 * (F.col("q1") / F.col("all_q1") - F.col("q0") / F.col("all_q0"))).alias("mix"), (F.col("q1") * (p1 - p0)).alias("price"),
    )
    first = F.abs("contribution").desc() if by == "contribution" else F.col("volume_pct").asc()
    got = got.withColumn("rank", F.row_number().over(Window.orderBy(first, *dims)))
    return got.where(F.col("rank") <= top) if top else got
