"""Causal graphs as edge tables: cycles, closures, separation, adjustment sets and paths in bulk.

For graphs too large for ``graph.Dag``, and for many questions to one graph at a time. Iterations
extend only what the last round found, and write each round as a table. A graph column, where the
tables have one (``by``), keeps many graphs apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.operators.fixed_effects import written


def closure(edges: DataFrame, by: Sequence[str] = (), source: str = "source", target: str = "target") -> DataFrame:
    """(by, source, target, steps): all pairs tied by a directed path, and the fewest steps. Semi-naive: each round joins the
    pairs that the last one found with the edges and keeps those not known before, so cycles end it as well."""
    links = written(edges.select(*by, F.col(source).alias("source"), F.col(target).alias("target")).distinct(), "edges")
    known = new = links.withColumn("steps", F.lit(1))
    step = links.select(*by, F.col("source").alias("target"), F.col("target").alias("_to"))
    steps = 1
    while True:
        steps += 1
        found = new.join(step, [*by, "target"]).select(*by, "source", F.col("_to").alias("target")).distinct()
        new = written(found.join(known, [*by, "source", "target"], "left_anti").withColumn("steps", F.lit(steps)), "frontier")
        if not new.limit(1).count():
            return known
        known = written(known.unionByName(new), "closure")


def cyclic(edges: DataFrame, by: Sequence[str] = (), source: str = "source", target: str = "target") -> DataFrame:
    """(by, node) of the nodes that lie on cycles or between them: what stays when nodes without edges in, or
    without edges out, are peeled off until none is left. Empty for a graph without cycles."""
    left = written(edges.select(*by, F.col(source).alias("source"), F.col(target).alias("target")).distinct(), "edges")
    while True:
        size = left.count()
        starts, ends = left.select(*by, F.col("source").alias("_n")).distinct(), left.select(*by, F.col("target").alias("_n")).distinct()
        # An edge stays if something leads to its source and its target leads on.
        into, out = ends.withColumnRenamed("_n", "source"), starts.withColumnRenamed("_n", "target")
        left = written(left.join(into, [*by, "source"], "left_semi").join(out, [*by, "target"], "left_semi"), "peeled")
        now = left.count()
        if now == size or not now:
            return left.select(*by, F.explode(F.array("source", "target")).alias("node")).distinct()


def separated(edges: DataFrame, questions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``questions`` (id, x, y, given array, [cut], by) with ``separated``: whether ``given`` d-separates x and y.

    Reachability over (node, direction) for all questions at once: a path may go on through a node that is not
    given, and turn at one where two edges meet only if it or a descendant is given. ``cut``, where it is
    there, names a node whose outgoing edges do not count (for back-door tests).
    """
    links = written(edges.select(*by, F.col("source").alias("a"), F.col("target").alias("b")).distinct(), "edges")
    cut = F.col("cut") if "cut" in questions.columns else F.lit(None).cast("string")
    ask = written(questions.select("id", *by, "x", "y", "given", cut.alias("cut")), "questions")
    mine = ["id", *by]
    # Each question's edges.
    own = ask.join(links, list(by)) if by else ask.join(links, F.lit(True))  # a stated set of questions against all edges
    own = written(own.where(F.col("cut").isNull() | (F.col("a") != F.col("cut"))).select(*mine, "given", "a", "b"), "own-edges")
    # Given nodes and their ancestors, at which two edges that meet let a path pass.
    open_ = new = written(ask.select(*mine, F.explode("given").alias("node")).distinct(), "open")
    while True:
        up = new.join(own.select(*mine, F.col("b").alias("node"), "a"), [*mine, "node"]).select(*mine, F.col("a").alias("node")).distinct()
        new = written(up.join(open_, [*mine, "node"], "left_anti"), "open")
        if not new.limit(1).count():
            break
        open_ = written(open_.unionByName(new), "open")
    # "up": the path came to the node from a child (or starts there); "down": from a parent.
    seen = new = written(ask.select(*mine, F.col("x").alias("node"), F.lit("up").alias("way")), "reached")
    to_parent, to_child = own.select(*mine, F.col("b").alias("node"), F.col("a").alias("_to")), own.select(*mine, F.col("a").alias("node"), F.col("b").alias("_to"))
    flags = ask.select(*mine, "given")
    marked = open_.withColumn("_open", F.lit(True))
    while True:
        here = new.join(flags, mine).join(marked, [*mine, "node"], "left").withColumn("_is_given", F.array_contains("given", F.col("node")))
        here = written(here.select(*mine, "node", "way", "_is_given", F.coalesce("_open", F.lit(False)).alias("_open")), "here")
        parents = here.where("(way = 'up' AND NOT _is_given) OR (way = 'down' AND _open)").join(to_parent, [*mine, "node"]).select(*mine, F.col("_to").alias("node"), F.lit("up").alias("way"))
        children = here.where("NOT _is_given").join(to_child, [*mine, "node"]).select(*mine, F.col("_to").alias("node"), F.lit("down").alias("way"))
        new = written(parents.unionByName(children).distinct().join(seen, [*mine, "node", "way"], "left_anti"), "reached")
        if not new.limit(1).count():
            break
        seen = written(seen.unionByName(new), "reached")
    hit = seen.select(*mine, F.col("node").alias("y")).distinct().withColumn("_hit", F.lit(True))
    got = ask.join(hit, [*mine, "y"], "left").select(*mine, (F.col("_hit").isNull() & (F.col("x") != F.col("y"))).alias("separated"))
    return questions.join(got, mine)


def backdoor_sets(edges: DataFrame, pairs: DataFrame, observed: DataFrame, by: Sequence[str] = (), most: int = 4) -> DataFrame:
    """(x, y, set, size, by): minimal adjustment sets of up to ``most`` observed nodes (``observed``: node, by) for each pair.

    Usable nodes of a pair are numbered, so that a set is a mask of bits. Level by level, sets that hold none
    found before (an anti-join by masks) are tested all at once. A pair may have up to 62 usable nodes.
    """
    names = ["x", "y", *by]
    below = written(closure(edges, by).select(*by, F.col("source").alias("x"), F.col("target").alias("node")), "below")
    usable = pairs.select(*names).join(observed.select(*by, "node"), list(by)) if by else pairs.select(*names).join(observed.select("node"), F.lit(True))
    usable = usable.where((F.col("node") != F.col("x")) & (F.col("node") != F.col("y"))).join(below, ["x", "node", *by], "left_anti")
    listed = usable.groupBy(*names).agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    listed = written(pairs.select(*names).join(listed, names, "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<string>"))), "usable")
    if listed.where(F.size("nodes") > 62).limit(1).count():
        raise ValueError("a pair has more than 62 usable nodes")
    level = listed.select(*names, F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("_last"))
    found = None
    for size in range(most + 1):
        if size:
            grown = level.join(listed, names).withColumn("_bit", F.explode_outer(F.expr("filter(sequence(0, 62), b -> b > _last AND b < size(nodes))"))).where("_bit IS NOT NULL")
            level = grown.select(*names, F.expr("mask | shiftleft(1L, _bit)").alias("mask"), F.col("_bit").alias("_last"))
            if found is not None:
                inside = found.select(*names, F.col("mask").alias("_known"))
                level = level.join(inside, [level[n].eqNullSafe(inside[n]) for n in names] + [F.expr("mask & _known = _known")], "left_anti")
            level = written(level, "level")
        asked = level.join(listed, names).select(*names, "mask", "_last", F.expr("transform(filter(sequence(0, 62), b -> b < size(nodes) AND shiftright(mask, b) & 1 = 1), b -> nodes[b])").alias("given"))
        asked = asked.withColumns({"id": F.concat_ws("|", "x", "y", *by, F.col("mask").cast("string")), "cut": F.col("x")})
        good = separated(edges, asked, by).where("separated").select(*names, "mask", "given", F.lit(size).alias("size"))
        found = written(good if found is None else found.unionByName(good), "sets")
        # Only sets that are none yet grow.
        level = written(level.join(found.select(*names, "mask"), [*names, "mask"], "left_anti"), "level")
        if not level.limit(1).count():
            break
    return found.select(*names, F.col("given").alias("set"), "size")


def directed_paths(edges: DataFrame, pairs: DataFrame, by: Sequence[str] = (), most: int = 400) -> DataFrame:
    """(x, y, path, by): all directed paths without repeated nodes of each pair. A pair with more than ``most`` gives its
    first ``most`` by length and order of nodes, and says so in ``cut`` (with their number so far in ``n_paths``).

    Paths grow a step a round from all pairs' starts at once, only towards nodes that lead to the pair's end. A pair stops
    after the round that gives it more than ``most``: later paths are longer, so none of its first ones is missed.
    """
    names = ["x", "y", *by]
    links = edges.select(*by, F.col("source").alias("_at"), F.col("target").alias("_to")).distinct()
    leads = written(closure(edges, by).select(*by, F.col("source").alias("_to"), F.col("target").alias("y")), "leads")
    asked = written(pairs.select(*names).distinct(), "pairs")
    going = asked.withColumns({"path": F.array("x"), "_at": F.col("x")})
    done = None
    while True:
        step = going.join(links, [*by, "_at"]).where(~F.array_contains("path", F.col("_to")))
        step = written(step.select(*names, F.concat("path", F.array("_to")).alias("path"), F.col("_to")), "paths")
        ended = step.where("_to = y").select(*names, "path")
        done = written(ended if done is None else done.unionByName(ended), "paths-done")
        full = done.groupBy(*names).count().where(F.col("count") > most).select(*names)
        on = step.where("_to != y").join(leads, ["y", *by, "_to"], "left_semi").join(full, names, "left_anti")
        going = written(on.select(*names, "path", F.col("_to").alias("_at")), "paths-going")
        if not going.limit(1).count():
            break
    counts = done.groupBy(*names).agg(F.count("*").alias("n_paths"), F.slice(F.sort_array(F.collect_list(F.struct(F.size("path").alias("s"), "path"))), 1, most).alias("p"))
    return counts.select(*names, "n_paths", (F.col("n_paths") > most).alias("cut"), F.explode("p.path").alias("path"))


def frontdoor_sets(edges: DataFrame, pairs: DataFrame, observed: DataFrame, by: Sequence[str] = (), most: int = 2) -> DataFrame:
    """(x, y, set, by): minimal sets of up to ``most`` (1 or 2) observed mediators on every directed path of the pair, with no
    open back door from x to each of them, nor from each to y given x and the others."""
    names = ["x", "y", *by]
    reach = written(closure(edges, by), "reach")
    after = reach.select(*by, F.col("source").alias("x"), F.col("target").alias("m"))
    ahead = reach.select(*by, F.col("source").alias("m"), F.col("target").alias("y"))
    between = pairs.select(*names).join(after, ["x", *by]).join(ahead, ["m", "y", *by]).join(observed.select(*by, F.col("node").alias("m")), ["m", *by], "left_semi")
    between = written(between.where("m != x AND m != y").select(*names, "m"), "mediators")
    paths = written(directed_paths(edges, pairs, by), "all-paths")
    if paths.where("cut").limit(1).count():
        raise ValueError("a pair has too many directed paths to judge mediators by")
    one = between.select(*names, F.array("m").alias("set"))
    found = None
    for size in range(1, most + 1):
        if size == 1:
            sets = one
        else:
            other = between.withColumnRenamed("m", "_m")
            sets = between.join(other, names).where("m < _m").select(*names, F.array("m", "_m").alias("set"))
            smaller = found.select(*names, F.col("set").alias("_known"))
            sets = sets.join(smaller, [sets[n].eqNullSafe(smaller[n]) for n in names] + [F.expr("size(array_except(_known, set)) = 0")], "left_anti")
        missed = sets.join(paths, names).where(~F.arrays_overlap("set", "path")).select(*names, "set").distinct()
        sets = written(sets.join(paths.select(*names).distinct(), names, "left_semi").join(missed, [*names, "set"], "left_anti"), "carriers")
        each = sets.select(*names, "set", F.explode("set").alias("m"))
        first = each.select(*names, "set", "m", F.lit("in").alias("test"), F.col("x").alias("_x"), F.col("m").alias("_y"), F.array().cast("array<string>").alias("given"))
        second = each.select(*names, "set", "m", F.lit("out").alias("test"), F.col("m").alias("_x"), F.col("y").alias("_y"), F.array_union(F.array("x"), F.array_remove("set", F.col("m"))).alias("given"))
        tests = written(first.unionByName(second).withColumn("id", F.concat_ws("|", *names, F.concat_ws(",", "set"), "m", "test")), "tests")
        asked = tests.select("id", *by, F.col("_x").alias("x"), F.col("_y").alias("y"), "given", F.col("_x").alias("cut"))
        verdict = separated(edges, asked, by).select("id", "separated")
        # Nothing that the tested node leads to may be conditioned on.
        bad = tests.withColumn("g", F.explode("given")).join(reach.select(*by, F.col("source").alias("_x"), F.col("target").alias("g")), ["_x", "g", *by]).select("id").distinct().withColumn("_bad", F.lit(True))
        judged = tests.join(verdict, "id").join(bad, "id", "left").groupBy(*names, "set").agg(F.every(F.col("separated") & F.col("_bad").isNull()).alias("ok"))
        good = judged.where("ok").select(*names, "set")
        found = written(good if found is None else found.unionByName(good), "carriers-found")
    return found
