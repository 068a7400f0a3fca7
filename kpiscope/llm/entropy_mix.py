"""Mixing sources to target weights by entropy balancing.  Built-in functions only.

A document's size is its number of words, runs of other characters than ``[\\x20\\x09-\\x0D]``.
Sources, ordered by code point with null last, get weights in turn and share ``share`` times all
words by them; a target stops at ``cap`` times its source's words, and what is over is shared
again by weight (water filling, solved exactly over the table of sources).

Each document's rate r (how many times it is taken) is the one of least relative entropy,
sum of r ln r - r, whose words meet its source's target with no rate over ``cap``: by duality
r = min(cap, exp(lambda * size)), one lambda a source. The convex dual is solved by Newton steps
over a histogram (source, size, documents): each step is one aggregation of gradient and Hessian by
source, kept inside a bracket that each step narrows; the state is a table, written each step. Sums
are decimals, so that no order of rows changes a result.

Rates become copies by systematic rounding: within a source documents are ordered by size, and
one of rate r gets as many copies as whole numbers lie in its stretch of the running sum of rates.
The sum of copies so stays within one of the rates' up to every size, and a source's words within one
largest document of its target; of ``PHASES`` offsets the one that comes nearest is taken. Copies
are dealt to equal sizes in parts (``SALTS``, by a hash of id and text), so that a size that a
third of all documents share is split. No document gets more than ``cap`` copies.

Null and empty texts have size 0: their rate is 1 and they take no words. Equal rows may get
different numbers of copies, the same ones as a set on each run. A null doc_id is a value like any other.
A source without words has target 0. An empty table gives no rows. Only the columns named are
read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.llm.common import materialise, require_columns

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and size are dealt to so many parts.
SALTS = 1024
#: Offsets tried for the rounding of each source.
PHASES = 32
#: Newton steps end when each source's words are this near to its target, or at the last step.
CLOSE, STEPS = 1e-9, 80


def words(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sources`` (key, source_size) with ``weight`` and ``target``.

    Sources are capped in order of cap * size / weight; the first whose bound is not reached by the
    level that those before it leave gives the level of all the rest.
    """
    turn = F.row_number().over(Window.orderBy(F.col("key") == "", "key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    bound = cap * F.col("source_size").cast("double")
    s = sources.withColumn("weight", weight).withColumn("bound", bound)
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("key") == "", "key")
    before = F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    goal = share * F.sum("source_size").over(Window.partitionBy()).cast("double")
    s = s.withColumn("level", (goal - before) / rest).withColumn("place", F.row_number().over(order))
    held = F.when(F.col("level") <= F.col("bound") / F.col("weight"), F.struct("place", "level"))
    s = s.withColumn("level", F.min(held).over(Window.partitionBy())["level"])
    return s.select("key", "source_size", "weight", F.least("bound", F.coalesce(F.col("weight") * F.col("level"), F.col("bound"))).alias("target"))


def _exact(value: Column) -> Column:
    """A sum that no order of rows changes."""
    return F.sum(value.cast("decimal(30,8)")).cast("double")


def solve_dual(groups: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """``goals`` with ``lam``: the root of words(lam) = target for each source.

    For sizes of one word and more ln(target / size) bounds the root on its side of 0, so the
    bracket is known before the first step. A source at its cap has lam = infinity.
    """
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    start = F.log(F.try_divide("target", "source_size"))
    state = goals.select(
        "*", F.when(full, F.lit(math.inf)).otherwise(0.0).alias("lam"), F.least(start, F.lit(0.0)).alias("low"), F.greatest(start, F.lit(0.0)).alias("high"),
        (full | (F.col("target") <= 0)).alias("done"),
    )
    state = materialise(state, "mix-dual")
    tilt = F.exp(F.col("lam") * F.col("size"))
    size = F.col("size").cast("double")
    for _ in range(STEPS):
        if not state.where(~F.col("done")).limit(1).count():
            break
        sums = (
            groups.join(state.where(~F.col("done")).select("key", "lam"), "key")
            .groupBy("key")
            .agg(
                _exact(F.col("n") * size * F.least(F.lit(cap), tilt)).alias("got"),
                _exact(F.when(tilt < cap, F.col("n") * size * size * tilt)).alias("slope"),
            )
        )
        s = state.join(sums, "key", "left")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        s = s.withColumn("low", F.when(F.col("done"), F.col("low")).otherwise(low)).withColumn("high", F.when(F.col("done"), F.col("high")).otherwise(high))
        newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
        near = F.abs(gap) <= CLOSE * F.col("target")
        narrow = (F.col("high") - F.col("low")) <= 1e-15 * F.greatest(F.abs("low"), F.abs("high"))
        over = F.col("done") | near | narrow
        state = materialise(
            s.select(
                *goals.columns, F.when(over, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), "low", "high", over.alias("done")
            ),
            "mix-dual",
        )
    return state.select(*goals.columns, "lam")


def rounded(groups: DataFrame, dual: DataFrame, cap: float) -> DataFrame:
    """``groups`` (key, size, n) with ``rate`` and ``k``, the copies of all its documents."""
    at = Window.partitionBy("key").orderBy("size")
    g = groups.join(dual, "key").withColumn("rate", F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size"))))
    g = g.withColumn("end", F.sum(F.col("rate") * F.col("n")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    g = materialise(g.withColumn("start", F.coalesce(F.lag("end").over(at), F.lit(0.0))), "mix-rates")

    def copies(offset: Column) -> Column:
        k = F.floor(F.col("end") + offset) - F.floor(F.col("start") + offset)
        return F.least(k, (F.lit(float(cap)) * F.col("n")).cast("long"))

    offsets = [(2 * i + 1) / (2 * PHASES) for i in range(PHASES)]
    off_by = F.array(*[F.abs(F.sum(copies(F.lit(u)) * F.col("size")).cast("double") - F.first("target")) for u in offsets])
    best = g.groupBy("key").agg(off_by.alias("off_by"))
    nearest = F.element_at(F.array(*map(F.lit, offsets)), F.array_position("off_by", F.array_min("off_by")).cast("int"))
    return g.join(best.select("key", nearest.alias("offset")), "key").withColumn("k", copies(F.col("offset")))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken, *carry) of each document.

    ``carry``: further columns to pass on, such as the text for ``expand``.
    """
    require_columns(docs, [doc_id, text, source, *carry])
    if share > cap:
        raise ValueError("no mix of that size keeps to the cap")
    col = lambda c: F.col(f"`{c}`")
    plain = ["doc_id", "source", "key", "size", "salt", "mark"]
    if set(carry) & {*plain, "source_size", "target", "rate", "copies", "taken"}:
        raise ValueError("a carried column has a result's name")
    name = col(source).cast("string")
    mark = F.xxhash64(col(doc_id), col(text))
    rows = docs.select(
        col(doc_id).alias("doc_id"), col(source).alias("source"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("key"), words(col(text)).alias("size"),
        F.pmod(mark, F.lit(SALTS)).cast("int").alias("salt"), mark.alias("mark"), *[col(c) for c in carry],
    )
    rows = materialise(rows, "mix-rows")
    cells = materialise(rows.groupBy("key", "size", "salt").agg(F.count("*").alias("n")), "mix-cells")
    every = materialise(cells.groupBy("key", "size").agg(F.sum("n").alias("n")), "mix-groups")
    sizes = every.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = materialise(targets(sizes, weights, share, cap), "mix-targets")
    groups = every.where("size > 0")
    dealt = rounded(groups, solve_dual(groups, goals, cap), cap).select("key", "size", "rate", "k", F.col("n").alias("n_group"))

    # Each part's copies are those of its stretch of the group's documents.
    by_size = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.where("size > 0").join(dealt, ["key", "size"]).withColumn("upto", F.sum("n").over(by_size))
    k = F.col("k").cast("decimal(19,0)")
    share_of = lambda upto: F.call_function("div", k * upto.cast("decimal(19,0)"), F.col("n_group").cast("decimal(19,0)"))
    c = c.select("key", "size", "salt", "n", "rate", (share_of(F.col("upto")) - share_of(F.col("upto") - F.col("n"))).alias("k"))

    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("mark", "doc_id"))
    got = rows.withColumn("rank", rank).join(c, ["key", "size", "salt"], "left").join(goals.select("key", "source_size", "target"), "key")
    each = F.call_function("div", F.col("k"), F.col("n")) + F.when(F.col("rank") <= F.col("k") % F.col("n"), 1).otherwise(0)
    copies = F.coalesce(each, F.lit(1)).cast("long")  # without words: once
    return got.select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry
    )


def expand(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` say, numbered from 1 in ``copy``."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
