"""Calendar columns: fiscal (April to March), ISO and Sunday weeks, holidays, promo windows.

All are built-in column expressions, so they stay inside code generation; holiday and promo
tables are small parameters that become ``CASE`` branches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Promo:
    name: str
    start: dt.date
    end: dt.date
    blackout: bool = False


#: The calendar of the analysed business.
HOLIDAYS: Mapping[dt.date, str] = {
    dt.date(2026, 1, 1): "New Year",
    dt.date(2026, 1, 26): "Republic Day",
    dt.date(2026, 3, 4): "Holi",
    dt.date(2026, 4, 14): "Baisakhi",
    dt.date(2026, 5, 1): "May Day",
    dt.date(2026, 8, 15): "Independence Day",
    dt.date(2026, 8, 26): "Onam",
}
PROMOS: Sequence[Promo] = (
    Promo("PROMO_REPUBLIC", dt.date(2026, 1, 20), dt.date(2026, 1, 27)),
    Promo("PROMO_SUMMER", dt.date(2026, 5, 8), dt.date(2026, 5, 20)),
    Promo("PROMO_FREEDOM", dt.date(2026, 8, 11), dt.date(2026, 8, 17), blackout=True),
)


def fiscal_year(d: Column, start_month: int = 4) -> Column:
    """``FY27`` for April 2026 to March 2027: the year in which it ends."""
    return F.concat(F.lit("FY"), F.lpad(((F.year(F.add_months(d, 1 - start_month)) + int(start_month > 1)) % 100).cast("string"), 2, "0"))


def fiscal_month(d: Column, start_month: int = 4) -> Column:
    return F.month(F.add_months(d, 1 - start_month))


def fiscal_quarter(d: Column, start_month: int = 4) -> Column:
    return F.concat(fiscal_year(d, start_month), F.lit("-Q"), F.ceil(fiscal_month(d, start_month) / 3).cast("string"))


def fiscal_period(d: Column, start_month: int = 4) -> Column:
    return F.concat(fiscal_year(d, start_month), F.lit("-P"), F.lpad(fiscal_month(d, start_month).cast("string"), 2, "0"))


def iso_week_start(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def fiscal_week_start(d: Column) -> Column:
    """The Sunday on or before."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def holiday_name(d: Column, holidays: Mapping[dt.date, str] = HOLIDAYS) -> Column:
    out = F.lit(None).cast("string")
    for day, name in holidays.items():
        out = F.when(d == F.lit(day), name).otherwise(out)
    return out


def promo_id(d: Column, promos: Sequence[Promo] = PROMOS) -> Column:
    """The first of the inclusive windows that holds the date."""
    out = F.lit(None).cast("string")
    for p in reversed(promos):
        out = F.when(d.between(F.lit(p.start), F.lit(p.end)), p.name).otherwise(out)
    return out


def baseline_eligible(d: Column, promos: Sequence[Promo] = PROMOS) -> Column:
    black = [p.name for p in promos if p.blackout]
    at = promo_id(d, promos)
    return at.isNull() | ~at.isin(black) if black else F.lit(True)


def conflicts(d: Column, promos: Sequence[Promo] = PROMOS, holidays: Mapping[dt.date, str] = HOLIDAYS) -> Column:
    """What makes calendars disagree about a date."""
    return F.array_compact(F.array(
        F.when(iso_week_start(d) != fiscal_week_start(d), "WEEK_START_MISMATCH"),
        F.when(holiday_name(d, holidays).isNotNull() & promo_id(d, promos).isNull(), "HOLIDAY_WITHOUT_PROMO"),
        F.when(~baseline_eligible(d, promos), "BASELINE_BLACKOUT"),
    ))


def stamp(df: DataFrame, date: str = "date", promos: Sequence[Promo] = PROMOS, holidays: Mapping[dt.date, str] = HOLIDAYS) -> DataFrame:
    """Add all calendar attributes of a date column."""
    d = F.col(date)
    return df.withColumns({
        "fiscal_year": fiscal_year(d), "fiscal_quarter": fiscal_quarter(d), "fiscal_period": fiscal_period(d),
        "iso_week_start": iso_week_start(d), "fiscal_week_start": fiscal_week_start(d), "weekday": F.weekday(d),
        "is_weekend": F.weekday(d) >= 5, "is_holiday": holiday_name(d, holidays).isNotNull(), "holiday": holiday_name(d, holidays),
        "promo_id": promo_id(d, promos), "is_promo": promo_id(d, promos).isNotNull(), "baseline_eligible": baseline_eligible(d, promos),
        "conflicts": conflicts(d, promos, holidays),
    })


def days(spark: SparkSession, start: dt.date, end: dt.date, name: str = "date") -> DataFrame:
    """One row for each date, both ends included; none if the end is before the start."""
    n = max(0, (end - start).days + 1)
    return spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias(name))


def dim_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return stamp(days(spark, start, end))


def eligible_days(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return days(spark, start, end).where(baseline_eligible(F.col("date")))
