"""Scalar columns: guarded ratios, thresholds, keys, money, hashes, numbers in text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b, unknown where b is zero or either is unknown."""
    return F.try_divide(a, b) * F.lit(scale) if scale != 1.0 else F.try_divide(a, b)


def crosses(pct: Column, limit: float, direction: str) -> Column:
    """Whether a movement reaches the alert limit in the direction up, down or both."""
    if direction == "up":
        return pct >= limit
    if direction == "down":
        return pct <= -limit
    if direction == "both":
        return F.abs(pct) >= limit
    raise ValueError(f"unknown direction {direction!r}")


def cell_key(*dims: str) -> Column:
    return F.concat_ws(" | ", *dims)


def history_days(as_of: Column, launch: Column) -> Column:
    return F.datediff(as_of, launch)


def newly_launched(as_of: Column, launch: Column, days: int = 60) -> Column:
    return F.coalesce(history_days(as_of, launch) < days, F.lit(False))


def two_places(v: Column) -> Column:
    """Two decimals as printf has them: from the exact binary value, ties to even.

    ``format_string`` rounds the shortest decimals half up: 621.005, in binary less than that, would be 621.01.
    Exact below 2^43; beyond that the shortest decimals may have fewer than two places.
    """
    odd = F.replace(F.lower(v.cast("string")), F.lit("infinity"), F.lit("inf"))
    return F.when(F.abs(v) < float("inf"), F.call_function("format_number", v, F.lit("0.00"))).otherwise(odd)


def money(v: Column) -> Column:
    """Crore from 1e7, lakh from 1e5, else a grouped integer (ties to even, no negative zero)."""
    return (
        F.when(F.abs(v) >= 1e7, F.concat(two_places(v / 1e7), F.lit(" crore")))
        .when(F.abs(v) >= 1e5, F.concat(two_places(v / 1e5), F.lit(" lakh")))
        .otherwise(F.format_number(F.rint(v).cast("long"), 0))
    )


def hash_id(n: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n)


def drop_denied(df: DataFrame, denied: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The table without denied columns, and which of them were there."""
    gone = [c for c in df.columns if c in set(denied)]
    return df.drop(*gone), gone


NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"


def numbers_in(text: Column) -> Column:
    """Signed numerals with thousands separators, as doubles."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("double"))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whole words, in any case."""
    return text.rlike(r"(?i)\b" + re.escape(phrase).replace(r"\ ", r"\s+") + r"\b")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))
