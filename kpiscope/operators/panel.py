"""Panels: one row a day with every node of the graph, and one row a cell and day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.calendar import days, stamp
from kpiscope.operators.movement import design_columns, solve


def daily_panel(spine: DataFrame, sources: Mapping[str, DataFrame], date: str = "date") -> DataFrame:
    """Left joins of daily tables on a calendar spine; what a source lacks stays unknown."""
    out = spine
    for name in sorted(sources):
        src = sources[name]
        out = out.join(src.select(date, *[c for c in src.columns if c != date]), date, "left")
    return out


def calendar_panel(spark, start: dt.date, end: dt.date, sources: Mapping[str, DataFrame]) -> DataFrame:
    return daily_panel(stamp(days(spark, start, end)), sources)


def unknown_before(df: DataFrame, column: str, launch: dt.date, date: str = "date") -> DataFrame:
    """A measure of something launched later is unknown before its launch, not zero."""
    return df.withColumn(column, F.when(F.col(date) >= F.lit(launch), F.col(column)))


def observed_mean(df: DataFrame, flag: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """Mean of observed flags; unknown where none is observed."""
    return df.groupBy(*by).agg(F.avg(flag).alias(flag))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_known, n, pct, status) in one aggregation, turned on its side."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = counts.select("_n", F.expr(f"stack({len(columns)}, {pairs}) as (variable, n_known)"))
    pct = F.coalesce(F.try_divide(100.0 * F.col("n_known"), F.col("_n")), F.lit(0.0))
    return long.select("variable", F.col("n_known").cast("long").alias("n_known"), F.col("_n").cast("long").alias("n"), F.round(pct, 2).alias("pct"), coverage_status(pct).alias("status"))


def coverage_status(pct: Column) -> Column:
    return F.when(pct > 99, "COMPLETE").when(pct >= 50, "PARTIAL").when(pct > 0, "SPARSE").otherwise("ABSENT")


def unit_panel(fact: DataFrame, cell: Sequence[str], measures: Sequence[str], date: str = "date") -> DataFrame:
    """One row a cell and date, with the cell's key."""
    got = fact.groupBy(date, *cell).agg(*[F.sum(m).alias(m) for m in measures])
    return got.withColumn("cell", F.concat_ws(" | ", *cell))


def is_balanced(panel: DataFrame, cell: str = "cell", period: str = "date", group: str | None = None) -> bool:
    """Whether every cell has each period of its group exactly once."""
    keys = [group] if group else []
    g = panel.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(cell).alias("c"), F.count_distinct(period).alias("p"))
    repeated = panel.groupBy(cell, period).count().where("count > 1").limit(1)
    return g.where("n != c * p").limit(1).count() == 0 and repeated.count() == 0


def seasonal_index(df: DataFrame, y: str, date: str = "date", least: int = 20) -> DataFrame:
    """Fitted calendar level over its intercept, from the first 60 % (30 at least) of the rows."""
    n = df.where(F.col(y).isNotNull()).count()
    first = max(30, int(0.6 * df.count()))
    x = design_columns(date=date)
    if n < least:
        return df.withColumn("seasonality", F.lit(0.0))
    ranked = df.withColumn("_r", F.row_number().over(Window.orderBy(date)))
    beta, _ = solve(ranked.where(F.col("_r") <= first), y, x)
    base = beta["const"] or 1.0
    fitted = sum((F.lit(b) * x[k] for k, b in beta.items()), F.lit(0.0))
    return df.withColumn("seasonality", fitted / F.lit(base))
