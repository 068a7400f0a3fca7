"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def registry(queries: dict[str, Query], sql: dict[str, str]):
    """A decorator factory: ``query(sql, dates)`` registers a function under its name.

    Dates leave both engines as text, as their clients' date types differ.
    """

    def query(text: str | None = None, dates: str = ""):
        names = dates.split()

        def add(f: Query) -> Query:
            @wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in names}) if names else f(spark, sf_dir)

            queries[f.__name__] = run
            if text:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in names)
                sql[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({text}) t" if names else text
            return run

        return add

    return query
