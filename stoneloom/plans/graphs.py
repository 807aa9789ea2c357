"""PageRank and shortest paths over the graph of suppliers that follow each other in orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import corpus, counting, graph, vertex
from ..scratch import persist_table
from ..sources import read_table
from .sql import materialized

#: Ids of nations and customers start here, beyond those of suppliers.
NATIONS, CUSTOMERS = 1_000_000_000, 2_000_000_000


def order_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): from supplier to supplier as they follow each other in orders, which has cycles,
    and from supplier to nation, which are dead ends."""
    items, suppliers = read_table(spark, d, "lineitem"), read_table(spark, d, "supplier")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    steps = items.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst"))
    ends = suppliers.select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + NATIONS).cast("long").alias("dst"))
    return persist_table(steps.where("dst IS NOT NULL AND src <> dst").union(ends).distinct(), "order-graph")


def sparse_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst) from customers to suppliers: targets are no sources."""
    orders, items = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    found = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return persist_table(found.select((F.col("o_custkey") + CUSTOMERS).alias("src"), F.col("l_suppkey").alias("dst")).distinct(), "sparse-graph")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def _ones(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.lit(1.0).alias("pr"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("pr", 6).alias("pr"))


def pr_step(spark: SparkSession, d: str) -> DataFrame:
    edges = order_graph(spark, d)
    return _rounded(graph.pagerank_step(_ones(nodes_of(edges)), edges))


def pr_total_mass(spark: SparkSession, d: str) -> DataFrame:
    edges = order_graph(spark, d)
    return graph.total_mass(_ones(nodes_of(edges)), edges).select(F.round("mass", 6).alias("mass"))


def _two_phase(rounds: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        edges = order_graph(spark, d)
        ranks = _ones(nodes_of(edges))
        return _rounded(graph.pagerank_two_phase(ranks, edges, ranks.count(), rounds, "none").df)

    return run


def pr_two_phase_converged(spark: SparkSession, d: str) -> DataFrame:
    """(iterations, converged, ids, total)."""
    edges = order_graph(spark, d)
    ranks = _ones(nodes_of(edges))
    found = graph.pagerank_two_phase(ranks, edges, ranks.count(), 50)
    return found.df.agg(F.count(F.lit(1)).alias("ids"), F.round(F.sum("pr"), 6).alias("total")).withColumns(
        {"iterations": F.lit(found.iterations), "converged": F.lit(found.converged)}
    )


def pr_new_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One round where targets are not among the nodes."""
    edges = sparse_graph(spark, d)
    ranks = _ones(edges.select(F.col("src").alias("id")).distinct())
    return _rounded(graph.pagerank_two_phase(ranks, edges, ranks.count(), 1, "none").df)


def pr_vertex_3(spark: SparkSession, d: str) -> DataFrame:
    edges = order_graph(spark, d)
    return _rounded(graph.pagerank_vertex(_ones(nodes_of(edges)), edges, 3, tolerance=None).df)


def pr_vertex_lost(spark: SparkSession, d: str) -> DataFrame:
    """Two updates where all that is sent is lost to missing vertices."""
    edges = sparse_graph(spark, d)
    ranks = _ones(edges.select(F.col("src").alias("id")).distinct())
    return _rounded(graph.pagerank_vertex(ranks, edges, 2, tolerance=None).df)


def pr_simple_3(spark: SparkSession, d: str) -> DataFrame:
    edges = order_graph(spark, d)
    return _rounded(graph.pagerank_simple(nodes_of(edges), edges, 3, tolerance=None).df)


def pr_change(spark: SparkSession, d: str) -> DataFrame:
    edges = order_graph(spark, d)
    ranks = _ones(nodes_of(edges))
    return graph.change(graph.pagerank_step(ranks, edges), ranks).select(F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


def _weighted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", (F.col("src") + F.col("dst")) % 7 + 1)


def _start(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.when(F.col("id") == 1, 0).otherwise(-1).cast("long").alias("dist"))


def bfs_step(spark: SparkSession, d: str) -> DataFrame:
    edges = _weighted(order_graph(spark, d))
    return graph.bfs_step(_start(nodes_of(edges)), edges)


def sssp(spark: SparkSession, d: str) -> DataFrame:
    edges = _weighted(order_graph(spark, d))
    return graph.sssp(_start(nodes_of(edges)), edges).df


def in_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_links(order_graph(spark, d))


def vertex_sssp(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths as a vertex program; null is not reached."""
    edges = _weighted(order_graph(spark, d))
    program, vertices = vertex.shortest_paths(1)
    return vertex.run(program, vertices(nodes_of(edges)), edges).df.select("id", F.col("value").alias("dist"))


def vertex_largest(spark: SparkSession, d: str) -> DataFrame:
    """Three supersteps of passing on the largest id."""
    edges = order_graph(spark, d)
    nodes = nodes_of(edges).select("id", F.col("id").alias("value"))
    return vertex.run(vertex.largest_value(), nodes, edges, max_supersteps=3).df


def first_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Of several adjacency rows of an order the one with most links."""
    rows = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_returnflag")
    rows = rows.agg(F.sort_array(F.collect_set("l_suppkey")).alias("links"))
    return graph_rows(corpus.first_by_id(rows.select("id", "links")))


def residue_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Rows by partition where the key's rest modulo seven is the partition."""
    dealt = counting.by_residue(read_table(spark, d, "orders").select("o_custkey"), "o_custkey", 7)
    return dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("keys"))


def graph_rows(nodes: DataFrame) -> DataFrame:
    """Links as text."""
    return nodes.select("id", F.array_join(F.transform("links", lambda x: x.cast("string")), " ").alias("links"))


QUERIES = {
    "pr_step": pr_step,
    "pr_total_mass": pr_total_mass,
    "pr_two_phase_1": _two_phase(1),
    "pr_two_phase_2": _two_phase(2),
    "pr_two_phase_3": _two_phase(3),
    "pr_two_phase_converged": pr_two_phase_converged,
    "pr_new_nodes": pr_new_nodes,
    "pr_vertex_3": pr_vertex_3,
    "pr_vertex_lost": pr_vertex_lost,
    "pr_simple_3": pr_simple_3,
    "pr_change": pr_change,
    "bfs_step": bfs_step,
    "sssp": sssp,
    "in_links": in_links,
    "vertex_sssp": vertex_sssp,
    "vertex_largest": vertex_largest,
    "first_by_id": first_by_id,
    "residue_partitions": residue_partitions,
}

_G = f"""WITH e AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS dst
    FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst
  UNION SELECT s_suppkey, s_nationkey + {NATIONS} FROM supplier
), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), s AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM e),
k AS (SELECT count(*)::DOUBLE AS n, 0.15::FLOAT::DOUBLE AS a FROM v), r0 AS (SELECT id, 1.0::DOUBLE AS pr FROM v)"""
_SPARSE = f"""WITH e AS (
  SELECT DISTINCT o_custkey + {CUSTOMERS} AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
), v AS (SELECT DISTINCT src AS id FROM e), s AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM e),
k AS (SELECT count(*)::DOUBLE AS n, 0.15::FLOAT::DOUBLE AS a FROM v), r0 AS (SELECT id, 1.0::DOUBLE AS pr FROM v)"""


def _round(i: int, join: str = "FULL") -> str:
    return (
        f", m{i} AS (SELECT dst AS id, sum(pr * share) AS p FROM r{i - 1} JOIN s ON id = src GROUP BY dst)"
        f", p{i} AS (SELECT id, coalesce(p, 0) AS p FROM r{i - 1} {join} JOIN m{i} USING (id))"
        f", r{i} AS (SELECT id, a / n + (1 - a) * (p + (n - (SELECT sum(p) FROM p{i})) / n) AS pr FROM p{i}, k)"
    )


#: Rounds within which the mass settles here.
SETTLED = 12


def _simple(i: int) -> str:
    return (
        f", m{i} AS (SELECT dst AS id, sum(pr * share) AS p FROM r{i - 1} JOIN s ON id = src GROUP BY dst)"
        f", r{i} AS (SELECT id, 0.15 / n + 0.85 * coalesce(p, 0) AS pr FROM r{i - 1} LEFT JOIN m{i} USING (id), k)"
    )


def _relax(i: int) -> str:
    return (
        f", n{i} AS (SELECT dst AS id, min(dist + (src + dst) % 7 + 1) AS near FROM d{i - 1} JOIN e ON id = src WHERE dist >= 0 GROUP BY dst)"
        f", d{i} AS (SELECT id, CAST(coalesce(least(CASE WHEN dist >= 0 THEN dist END, near), -1) AS BIGINT) AS dist"
        f" FROM d{i - 1} LEFT JOIN n{i} USING (id))"
    )


_D0 = ", d0 AS (SELECT id, CASE WHEN id = 1 THEN 0 ELSE -1 END AS dist FROM v)"


def _ranks(i: int) -> str:
    return f" SELECT id, round(pr, 6) AS pr FROM r{i}"


ORACLES = {
    "pr_step": _G
    + ", m AS (SELECT dst AS id, sum(share) AS p FROM s GROUP BY dst) SELECT id, round(coalesce(p, 0), 6) AS pr FROM v LEFT JOIN m USING (id)",
    "pr_total_mass": _G + " SELECT round(sum(share), 6) AS mass FROM s",
    "pr_two_phase_1": _G + _round(1) + _ranks(1),
    "pr_two_phase_2": _G + _round(1) + _round(2) + _ranks(2),
    "pr_two_phase_3": _G + _round(1) + _round(2) + _round(3) + _ranks(3),
    "pr_new_nodes": _SPARSE + _round(1) + _ranks(1),
    "pr_vertex_3": _G + _round(1, "LEFT") + _round(2, "LEFT") + _round(3, "LEFT") + _ranks(3),
    "pr_vertex_lost": _SPARSE + _round(1, "LEFT") + _round(2, "LEFT") + _ranks(2),
    "pr_simple_3": _G.replace("SELECT id, 1.0::DOUBLE AS pr FROM v", "SELECT id, 1 / n AS pr FROM v, k")
    + _simple(1)
    + _simple(2)
    + _simple(3)
    + _ranks(3),
    "pr_change": _G
    + ", m AS (SELECT dst AS id, sum(share) AS p FROM s GROUP BY dst), c AS (SELECT abs(coalesce(p, 0) - 1) AS c FROM v LEFT JOIN m USING (id))"
    " SELECT round(sum(c), 6) AS total, round(avg(c), 6) AS mean FROM c",
    "bfs_step": _G + _D0 + _relax(1) + " SELECT id, dist FROM d1",
    # shortest paths have fewer edges than this here; further rounds change nothing
    "sssp": _G + _D0 + "".join(_relax(i) for i in range(1, 13)) + " SELECT id, dist FROM d12",
    "in_links": _G + " SELECT dst AS id, count(*) AS n FROM e GROUP BY dst",
    "pr_two_phase_converged": materialized(
        _G
    + "".join(map(_round, range(1, SETTLED + 1)))
    + ", m AS (" + " UNION ALL ".join(f"SELECT {i} AS i, sum(p) AS m FROM p{i}" for i in range(1, SETTLED + 1)) + ")"
    + ", stop AS (SELECT min(b.i) AS i FROM m a JOIN m b ON b.i = a.i + 1 WHERE abs(a.m - b.m) < 0.001)"
    + ", r AS (" + " UNION ALL ".join(f"SELECT {i} AS i, pr FROM r{i}" for i in range(2, SETTLED + 1)) + ")"
    + " SELECT count(*) AS ids, round(sum(pr), 6) AS total, CAST(any_value(i) AS INTEGER) AS iterations, true AS converged FROM r JOIN stop USING (i)"
    ),
    "vertex_sssp": _G + _D0 + "".join(_relax(i) for i in range(1, 13)) + " SELECT id, CASE WHEN dist >= 0 THEN dist END AS dist FROM d12",
    "vertex_largest": _G + ", l0 AS (SELECT id, id AS value FROM v)"
    + "".join(
        f", l{i} AS (SELECT id, greatest(value, coalesce(m, value)) AS value FROM l{i - 1} LEFT JOIN"
        f" (SELECT dst AS id, max(value) AS m FROM l{i - 1} JOIN e ON id = src GROUP BY dst) USING (id))"
        for i in (1, 2, 3)
    )
    + " SELECT id, value FROM l3",
    "first_by_id": "WITH l AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey)) AS links FROM lineitem GROUP BY l_orderkey, l_returnflag)"
    " SELECT id, array_to_string(links, ' ') AS links FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(links) DESC, links) = 1",
    "residue_partitions": "SELECT CAST(o_custkey % 7 AS INTEGER) AS part, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY 1",
}
