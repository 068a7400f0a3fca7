"""Two-way fixed effects on panels with holes, as alternating projections over tables.

Means by cell and means by (group and) period are taken out of the columns in turn until they change
by no more than a bound. Each round is two aggregations, whose effects of periods are written as a table, so that
the lineage stays short; a cell or period of any size is only ever summed. On a balanced panel the second round is the last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.operators.regress import inferred
from kpiscope.sources.files import scratch_path

#: Rounds end when no mean is above this share of its column's spread, or at the last one.
BOUND, ROUNDS = 1e-11, 300


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read back: what comes after does not compute it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def absorbed(panel: DataFrame, columns: Sequence[str], cells: Sequence[str], times: Sequence[str], bound: float = BOUND, rounds: int = ROUNDS) -> DataFrame:
    """``panel`` with each of ``columns`` (doubles) freed of the effects of cells and times.

    Only the effects of times go from round to round: those of cells are means of what they leave, and
    the next ones of times are means of what these leave. The panel itself is written by none.
    """
    spread = panel.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    scale = {c: spread[c] or 1.0 for c in columns}

    def effects(by: Sequence[str], other: DataFrame | None, of: Sequence[str]) -> DataFrame:
        """Means by ``by`` of the columns less the other side's effects."""
        rows = panel if other is None else panel.join(other.select(*of, *[F.col(f"_e_{c}").alias(f"_o_{c}") for c in columns]), list(of))
        left = {c: F.col(c) - (F.col(f"_o_{c}") if other is not None else 0.0) for c in columns}
        return rows.groupBy(*by).agg(*[F.avg(v).alias(f"_e_{c}") for c, v in left.items()])

    by_time: DataFrame | None = None
    for _ in range(rounds):
        new = effects(times, effects(cells, by_time, times), cells)
        if by_time is None:
            by_time = written(new, "within")
            continue
        old = by_time.select(*times, *[F.col(f"_e_{c}").alias(f"_o_{c}") for c in columns])
        change = F.greatest(F.lit(0.0), *[F.abs(F.col(f"_e_{c}") - F.col(f"_o_{c}")) / scale[c] for c in columns])
        by_time = written(new.join(old, list(times)).withColumn("_change", change).drop(*[f"_o_{c}" for c in columns]), "within")
        most = by_time.agg(F.max("_change")).first()[0]
        by_time = by_time.drop("_change")
        if most is None or most <= bound:
            break
    by_cell = effects(cells, by_time, times)
    got = panel.join(by_time, list(times)).withColumns({c: F.col(c) - F.col(f"_e_{c}") for c in columns}).drop(*[f"_e_{c}" for c in columns])
    got = got.join(by_cell, list(cells)).withColumns({c: F.col(c) - F.col(f"_e_{c}") for c in columns}).drop(*[f"_e_{c}" for c in columns])
    return written(got, "within")


def components(panel: DataFrame, left: Sequence[str], right: Sequence[str]) -> int:
    """Connected parts of the graph that ties each left key to the right keys it occurs with:
    the least left key spreads until none changes."""
    name = lambda cols: F.to_json(F.struct(*[F.col(c).cast("string") for c in cols]))
    links = written(panel.select(name(left).alias("a"), name(right).alias("b")).distinct(), "links")
    labels = links.select("a", F.col("a").alias("label")).distinct()
    while True:
        over = links.join(labels, "a").groupBy("b").agg(F.min("label").alias("label"))
        new = written(links.join(over, "b").groupBy("a").agg(F.min("label").alias("new")).join(labels, "a"), "labels")
        labels = new.select("a", F.least("new", "label").alias("label"))
        if not new.where("new < label").limit(1).count():
            return labels.select("label").distinct().count()


def within(panel: DataFrame, y: str, x: str, cell: str = "cell", period: str = "date", group: str | None = None) -> DataFrame:
    """(estimate, se, t, p, low, high, cells, n): the slope of y on x within cells and (group x) periods,
    its error clustered by cell with t(cells - 1). One row; null where x does not vary within them or there is one cell."""
    times = [*([group] if group else []), period]
    keys = list(dict.fromkeys([cell, *times]))
    rows = panel.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    rows = written(rows, "panel")
    both = absorbed(rows, ["_y", "_x"], [cell], times)
    counts = rows.agg(F.count_distinct(cell).alias("cells"), F.count_distinct(*times).alias("times")).first()
    rank = counts["cells"] + counts["times"] - (components(rows, [cell], times) if counts["cells"] else 0)
    cells = both.groupBy(cell).agg(F.sum(F.col("_x") * F.col("_y")).alias("sy"), F.sum(F.col("_x") * F.col("_x")).alias("sx"), F.count("*").alias("k"))
    s = cells.agg(
        F.sum("sy").alias("xy"), F.sum("sx").alias("xx"), F.sum(F.col("sy") * F.col("sy")).alias("yy2"), F.sum(F.col("sy") * F.col("sx")).alias("xy2"),
        F.sum(F.col("sx") * F.col("sx")).alias("xx2"), F.sum("k").alias("n"), F.count("*").alias("cells"),
    )
    # A cell's score is sy - estimate * sx.
    fine = (F.col("xx") > 1e-10) & (F.col("cells") > 1)
    s = s.withColumn("estimate", F.when(fine, F.col("xy") / F.col("xx")))
    b = F.col("estimate")
    square = F.greatest(F.col("yy2") - 2 * b * F.col("xy2") + b * b * F.col("xx2"), F.lit(0.0))
    g, n = F.col("cells"), F.col("n")
    s = s.withColumn("_var", F.try_divide(square, F.col("xx") * F.col("xx")) * g / F.greatest(g - 1, F.lit(1)) * (n - 1) / F.greatest(n - rank - 1, F.lit(1)))
    got = inferred("estimate", "_var", "(cells - 1)")
    return s.select(*[c.alias(k) for k, c in got.items()], "cells", "n")


def did(panel: DataFrame, y: str, treated: str = "treated", post: str = "post", cell: str = "cell", period: str = "date", group: str | None = None) -> DataFrame:
    """The effect on treated cells after the change, of any panel."""
    d = (F.col(treated) & F.col(post)).cast("double")
    return within(panel.withColumn("_d", d), y, "_d", cell, period, group)


def parallel_trends(panel: DataFrame, y: str, treated: str = "treated", post: str = "post", cell: str = "cell", period: str = "date", group: str | None = None) -> DataFrame:
    """The treated cells' extra trend a period before the change, of any panel."""
    before = panel.where(~F.col(post) & F.col(y).isNotNull())
    places = before.select(period).distinct()
    # Periods are numbered by range: each part counts from the periods before it.
    ordered = written(places.orderBy(period).withColumn("_id", F.monotonically_increasing_id()), "periods")
    sizes = ordered.groupBy(F.shiftright("_id", 33).alias("part")).count().orderBy("part").collect()
    first, total = {}, 0
    for r in sizes:
        first[r["part"]], total = total, total + r["count"]
    base = F.create_map(*[F.lit(v) for kv in first.items() for v in kv]) if first else F.lit(None)
    part = F.shiftright("_id", 33)
    at = F.col("_id") - F.shiftleft(part, 33) + (base[part] if first else F.lit(0))
    numbered = ordered.select(period, at.cast("double").alias("_at"))
    got = before.join(numbered, period).withColumn("_x", F.col(treated).cast("double") * F.col("_at"))
    return within(got, y, "_x", cell, period, group)
