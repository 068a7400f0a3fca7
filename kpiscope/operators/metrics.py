"""KPI computation at a permitted grain, by the contract's aggregation over time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.calendar import fiscal_period
from kpiscope.functions.formula import FormulaError, compile_formula, names

FLOW, STOCK, RATIO = "FLOW", "STOCK", "RATIO"


@dataclass(frozen=True)
class Kpi:
    kpi_id: str
    formula: str
    time_aggregation: str = FLOW
    scale: float = 1.0
    grain: tuple[str, ...] = ("date", "region", "product_line")
    alert_pct: float = 3.0
    alert_direction: str = "both"
    materiality_abs: float = 1.0
    materiality_pct: float = 1.0
    multiplier: int = 12
    not_interchangeable_with: tuple[str, ...] = ()
    access: Mapping[str, Mapping[str, object]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return names(self.formula)


class ContractViolation(ValueError):
    """A request that the contract forbids."""


def kpi_series(fact: DataFrame, kpi: Kpi, dims: Sequence[str] = (), date: str = "date", row_filter: Column | None = None) -> DataFrame:
    """The KPI for each date and dimension: components are summed, then the formula applied.

    The row filter stands below the aggregation. A ratio is thus the ratio of sums.
    """
    missing = [c for c in kpi.columns if c not in fact.columns]
    if missing:
        raise FormulaError(f"{kpi.kpi_id} needs the columns {missing}")
    src = fact if row_filter is None else fact.where(row_filter)
    sums = src.groupBy(date, *dims).agg(*[F.sum(c).alias(c) for c in kpi.columns])
    return sums.withColumn("value", compile_formula(kpi.formula, sums.columns) * F.lit(kpi.scale))


def window_value(series: DataFrame, kpi: Kpi, start: dt.date, end: dt.date, date: str = "date") -> DataFrame:
    """One value for an inclusive window: flows add up, stocks are the last day's total, ratios
    are computed anew from summed components. No rows: unknown."""
    inside = series.where(F.col(date).between(F.lit(start), F.lit(end)))
    if kpi.time_aggregation == STOCK:
        daily = inside.groupBy(date).agg(F.sum("value").alias("value"))
        return daily.agg(F.max_by("value", date).alias("value"))
    if kpi.time_aggregation == RATIO:
        sums = inside.agg(*[F.sum(c).alias(c) for c in kpi.columns])
        return sums.select((compile_formula(kpi.formula, sums.columns) * F.lit(kpi.scale)).alias("value"))
    return inside.agg(F.sum("value").alias("value"))


def daily_mean(series: DataFrame, start: dt.date, end: dt.date, date: str = "date") -> DataFrame:
    """Mean of daily totals: windows of unlike length compare."""
    daily = series.where(F.col(date).between(F.lit(start), F.lit(end))).groupBy(date).agg(F.sum("value").alias("value"))
    return daily.agg(F.avg("value").alias("value"), F.count("*").alias("n_days"))


def fiscal_rollup(fact: DataFrame, kpi: Kpi, dims: Sequence[str] = ("region",), date: str = "date", row_filter: Column | None = None) -> DataFrame:
    """Fiscal periods, dated by the last date that any row has in the period.

    Without a row filter the facts are read once: each group's last date comes with its sums, and
    the period's is the largest of these. A filter stands below the sums, not below the dates.
    """
    src = fact if row_filter is None else fact.where(row_filter)
    period = fiscal_period(F.col(date))
    sums = src.groupBy(period.alias("fiscal_period"), *dims).agg(*[F.sum(c).alias(c) for c in kpi.columns], F.max(date).alias("_last"))
    if row_filter is None:
        ends = F.max("_last").over(Window.partitionBy("fiscal_period"))
        got = sums.withColumn(date, ends)
    else:
        ends = fact.groupBy(period.alias("fiscal_period")).agg(F.max(date).alias(date))
        got = sums.join(ends, "fiscal_period")
    return got.drop("_last").withColumn("value", compile_formula(kpi.formula, sums.columns))


def grain_lattice(fact: DataFrame, measures: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """All permitted grains in one pass: grouping sets over prefixes of the dimensions."""
    return fact.rollup(*dims).agg(*[F.sum(m).alias(m) for m in measures], F.grouping_id().alias("grain_id"))


def comparable(a: Kpi, b: Kpi) -> None:
    """Refuse to set two KPIs against each other that the contract holds apart."""
    if b.kpi_id in a.not_interchangeable_with or a.kpi_id in b.not_interchangeable_with:
        raise ContractViolation(f"{a.kpi_id} and {b.kpi_id} are not interchangeable")


def points(series: DataFrame, date: str = "date") -> DataFrame:
    """(date, value) of a series' totals without unknown values, in order."""
    return series.groupBy(date).agg(F.sum("value").alias("value")).where("value is not null").orderBy(date)


def last_stock(df: DataFrame, value: str, date: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, date).alias("first_value"), F.max_by(value, date).alias("last_value"))


def segment_revenue_per_day(fact: DataFrame, segment: Column, start: dt.date, end: dt.date, value: str = "net_revenue", date: str = "date") -> DataFrame:
    """A segment's value for each day of the window that has any of its rows."""
    inside = fact.where(segment & F.col(date).between(F.lit(start), F.lit(end)))
    return inside.agg((F.sum(value).cast("double") / F.greatest(F.count_distinct(date), F.lit(1))).alias("per_day"))


def baseline_price(fact: DataFrame, segment: Column, start: dt.date, end: dt.date, value: str = "net_revenue", quantity: str = "units_sold", date: str = "date") -> DataFrame:
    """A segment's price in the window: summed value over summed quantity."""
    inside = fact.where(segment & F.col(date).between(F.lit(start), F.lit(end)))
    return inside.agg(F.try_divide(F.sum(value).cast("double"), F.sum(quantity).cast("double")).alias("price"))


def exposure(rule: str, *, effect: float | None = None, cells: int = 1, price: float | None = None, term: float | None = None, before: float | None = None, after: float | None = None) -> float:
    """Value a day at stake: DID (effect x treated cells x price), TERM (a decomposition term),
    or DELTA (the segment's change). What is unknown counts as nothing at stake."""
    if rule == "DID":
        return 0.0 if effect is None or price is None else effect * cells * price
    if rule == "TERM":
        return term or 0.0
    if rule == "DELTA":
        return 0.0 if before is None or after is None else after - before
    raise ValueError(f"unknown exposure rule {rule!r}")
