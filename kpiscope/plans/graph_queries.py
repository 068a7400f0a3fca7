"""Graph questions in bulk, over graphs that the tables give: each customer's successions of part types,
and for each nation the pairs of types that its orders hold together more often than all orders do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiscope.operators import graph_tables
from kpiscope.plans import model as m
from kpiscope.plans.registry import registry

QUERIES, SQL = {}, {}
query = registry(QUERIES, SQL)

_NEXT = """l AS (SELECT o_custkey AS customer, l_orderkey, p_type, lead(p_type) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS next FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
e AS (SELECT DISTINCT customer, p_type AS source, next AS target FROM l WHERE next <> p_type),
c AS (SELECT customer, source, target, 1 AS steps FROM e UNION SELECT c.customer, c.source, e.target, steps + 1 FROM c JOIN e ON e.customer = c.customer AND e.source = c.target WHERE steps < 6),
k AS (SELECT customer, source, target, min(steps) AS steps FROM c GROUP BY ALL)"""


def successions(spark: SparkSession, sf: str) -> DataFrame:
    """Which part type follows which within a customer's orders."""
    lines = m.t(spark, sf, "lineitem").join(m.t(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    pairs = lines.select("l_orderkey", F.col("p_type").alias("source"), F.lead("p_type").over(w).alias("target")).where("target != source")
    orders = m.t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"))
    return pairs.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("customer", "source", "target").distinct()


@query(f"WITH RECURSIVE {_NEXT} SELECT * FROM k")
def graph_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All types that a type leads to in each customer's graph, and in how many steps at least."""
    return graph_tables.closure(successions(spark, sf), ["customer"])


@query(f"""WITH RECURSIVE {_NEXT}, y AS (SELECT customer, source AS node FROM k WHERE source = target)
SELECT DISTINCT y.customer, y.node FROM y UNION SELECT DISTINCT a.customer, a.target FROM k a JOIN y ON y.customer = a.customer AND y.node = a.source JOIN k b ON b.customer = a.customer AND b.source = a.target JOIN y z ON z.customer = b.customer AND z.node = b.target""")
def graph_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The types on or between cycles of each customer's graph."""
    return graph_tables.cyclic(successions(spark, sf), ["customer"])


_NATION = """ot AS (SELECT DISTINCT l_orderkey, n_name AS nation, p_type FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
pc AS (SELECT a.nation, a.p_type AS source, b.p_type AS target, count(*) AS n FROM ot a JOIN ot b ON a.l_orderkey = b.l_orderkey AND a.p_type < b.p_type GROUP BY ALL),
e AS (SELECT nation AS g, source AS a, target AS b FROM (SELECT *, sum(n) OVER (PARTITION BY nation) AS mine, sum(n) OVER (PARTITION BY source, target) AS pair, sum(n) OVER () AS every FROM pc) WHERE CAST(n AS HUGEINT) * every > CAST(pair AS HUGEINT) * mine),
nd AS (SELECT g, a AS node FROM e UNION SELECT g, b FROM e)"""


def nation_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between part types, in alphabetic order, that stand out among a nation's orders."""
    types = m.t(spark, sf, "lineitem").join(m.t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_type")).alias("types"))
    orders = m.t(spark, sf, "orders").join(m.t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(m.t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    each = types.join(orders.select("o_orderkey", F.col("n_name").alias("nation")), F.col("l_orderkey") == F.col("o_orderkey")).select("nation", "types", F.posexplode("types").alias("i", "source"))
    counts = each.withColumn("target", F.explode(F.slice("types", F.col("i") + 2, F.size("types")))).groupBy("nation", "source", "target").count()
    of = lambda *cols: F.sum("count").over(Window.partitionBy(*cols)).cast("decimal(19,0)")  # noqa: E731  a row for each nation and pair of types
    more = F.col("count").cast("decimal(19,0)") * of() > of("source", "target") * of("nation")
    return counts.withColumn("more", more).where("more").select("nation", "source", "target")


def _separation(questions: str) -> str:
    """CTEs: ``q`` (id, g, x, y, z, cut), and ``st``, whose rows (id, node) are what x reaches."""
    return f"""q AS ({questions}), oe AS (SELECT q.id, q.z, e.a, e.b FROM q JOIN e ON e.g = q.g WHERE q.cut IS NULL OR e.a <> q.cut),
op AS (SELECT id, unnest(z) AS node FROM q UNION SELECT oe.id, oe.a FROM op JOIN oe ON oe.id = op.id AND oe.b = op.node), ways AS (SELECT unnest(['up', 'down']) AS w),
mv AS (SELECT oe.id, oe.b AS n, w, oe.a AS t, 'up' AS tw FROM oe CROSS JOIN ways LEFT JOIN (SELECT DISTINCT * FROM op) op ON op.id = oe.id AND op.node = oe.b WHERE (w = 'up' AND NOT list_contains(oe.z, oe.b)) OR (w = 'down' AND op.node IS NOT NULL)
 UNION ALL SELECT oe.id, oe.a, w, oe.b, 'down' FROM oe CROSS JOIN ways WHERE NOT list_contains(oe.z, oe.a)),
st AS (SELECT id, x AS node, 'up' AS way FROM q UNION SELECT mv.id, mv.t, mv.tw FROM st JOIN mv ON mv.id = st.id AND mv.n = st.node AND mv.w = st.way), hit AS (SELECT DISTINCT id, node FROM st)"""


_TRIPLES = "SELECT (x.g, x.node, y.node, z.node) AS id, x.g, x.node AS x, y.node AS y, CASE WHEN z.node IS NULL THEN [] ELSE [z.node] END AS z, NULL AS cut FROM nd x JOIN nd y ON y.g = x.g AND x.node < y.node JOIN (SELECT g, node FROM nd UNION ALL SELECT DISTINCT g, NULL FROM nd) z ON z.g = x.g AND (z.node IS NULL OR (z.node <> x.node AND z.node <> y.node))"


@query(f"WITH RECURSIVE {_NATION}, {_separation(_TRIPLES)} SELECT q.g AS nation, q.x, q.y, array_to_string(q.z, ',') AS given, hit.id IS NULL AS separated FROM q LEFT JOIN hit ON hit.id = q.id AND hit.node = q.y")
def graph_separation(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two types are separated by nothing or by one other, for all in each nation's graph."""
    e = graph_tables.written(nation_graphs(spark, sf), "graphs")
    nodes = e.select("nation", F.explode(F.array("source", "target")).alias("node")).groupBy("nation").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    x = nodes.select("nation", "nodes", F.explode("nodes").alias("x")).withColumn("y", F.explode("nodes")).where("x < y")
    z = F.concat(F.array(F.array().cast("array<string>")), F.transform(F.array_except("nodes", F.array("x", "y")), lambda v: F.array(v)))
    asked = x.withColumn("given", F.explode(z)).select(F.concat_ws("|", "nation", "x", "y", F.concat_ws(",", "given")).alias("id"), "nation", "x", "y", "given")
    return graph_tables.separated(e, asked, ["nation"]).select("nation", "x", "y", F.concat_ws(",", "given").alias("given"), "separated")


_SETS = """SELECT (p.g, p.x, p.y, s.mask) AS id, p.g, p.x, p.y, list_sort(list(u.node) FILTER (s.mask >> CAST(u.bit AS INTEGER) & 1 = 1)) AS z, p.x AS cut, s.mask FROM pr p JOIN (SELECT unnest(generate_series(0, 15)) AS mask) s ON s.mask < (1 << CAST(p.n AS INTEGER)) LEFT JOIN us u ON u.g = p.g AND u.x = p.x AND u.y = p.y GROUP BY p.g, p.x, p.y, s.mask"""


@query(f"""WITH RECURSIVE {_NATION}, dc AS (SELECT g, a, b FROM e UNION SELECT dc.g, dc.a, e.b FROM dc JOIN e ON e.g = dc.g AND e.a = dc.b),
us AS (SELECT x.g, x.node AS x, y.node AS y, u.node, row_number() OVER (PARTITION BY x.g, x.node, y.node ORDER BY u.node) - 1 AS bit FROM nd x JOIN nd y ON y.g = x.g AND y.node <> x.node JOIN nd u ON u.g = x.g AND u.node NOT IN (x.node, y.node) WHERE NOT EXISTS (SELECT 1 FROM dc WHERE dc.g = x.g AND dc.a = x.node AND dc.b = u.node)),
pr AS (SELECT x.g, x.node AS x, y.node AS y, count(us.node) AS n FROM nd x JOIN nd y ON y.g = x.g AND y.node <> x.node LEFT JOIN us ON us.g = x.g AND us.x = x.node AND us.y = y.node GROUP BY ALL), qs AS ({_SETS}),
{_separation("SELECT id, g, x, y, coalesce(z, []) AS z, cut FROM qs")},
ok AS (SELECT q.g, q.x, q.y, q.z FROM q LEFT JOIN hit ON hit.id = q.id AND hit.node = q.y WHERE hit.id IS NULL)
SELECT g AS nation, x, y, array_to_string(z, ',') AS adjust, len(z) AS size FROM ok WHERE NOT EXISTS (SELECT 1 FROM ok s WHERE s.g = ok.g AND s.x = ok.x AND s.y = ok.y AND len(s.z) < len(ok.z) AND list_has_all(ok.z, s.z))""")
def graph_backdoor(spark: SparkSession, sf: str) -> DataFrame:
    """Minimal adjustment sets of each ordered pair of types in each nation's graph."""
    e = graph_tables.written(nation_graphs(spark, sf), "graphs")
    nodes = e.select("nation", F.explode(F.array("source", "target")).alias("node")).distinct()
    listed = nodes.groupBy("nation").agg(F.collect_set("node").alias("nodes"))
    pairs = listed.withColumn("x", F.explode("nodes")).withColumn("y", F.explode("nodes")).where("x != y").select("nation", "x", "y")
    got = graph_tables.backdoor_sets(e, pairs, nodes, ["nation"])
    return got.select("nation", "x", "y", F.concat_ws(",", "set").alias("adjust"), F.col("size").cast("long").alias("size"))


@query(f"""WITH RECURSIVE {_NATION}, w AS (SELECT g, a AS x, b AS y, [a, b] AS path FROM e UNION ALL SELECT w.g, w.x, e.b, list_append(w.path, e.b) FROM w JOIN e ON e.g = w.g AND e.a = w.y)
SELECT g AS nation, x, y, array_to_string(path, ' > ') AS path, count(*) OVER (PARTITION BY g, x, y) AS n_paths, false AS cut FROM w""")
def graph_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All directed paths of each nation's graph."""
    e = graph_tables.written(nation_graphs(spark, sf), "graphs")
    listed = e.select("nation", F.explode(F.array("source", "target")).alias("node")).groupBy("nation").agg(F.collect_set("node").alias("nodes"))
    pairs = listed.withColumn("x", F.explode("nodes")).withColumn("y", F.explode("nodes")).where("x < y").select("nation", "x", "y")
    return graph_tables.directed_paths(e, pairs, ["nation"]).select("nation", "x", "y", F.concat_ws(" > ", "path").alias("path"), "n_paths", "cut")
