from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stoneloom.operators import graph
from stoneloom.sources import parse_link_graph, parse_text_graph, parse_weighted_graph, write_graph


def edges(spark, links):
    return spark.createDataFrame([(a, b) for a, bs in links.items() for b in bs], "src long, dst long")


def ones(spark, ids):
    return spark.createDataFrame([(i, 1.0) for i in ids], "id long, pr double")


def ranks(df):
    return {r["id"]: round(r["pr"], 6) for r in df.collect()}


DEAD_END = {1: [2, 3], 2: [3]}


def test_step(spark):
    lines = spark.createDataFrame([("1 0.5 (2, 7), (3, 9)",), ("2 0.3 [3 1]",), ("3 0.2 1 4",)], "value string")
    nodes = parse_weighted_graph(lines)
    start = nodes.select("id", F.col("value").alias("pr"))
    links = nodes.select("id", F.transform("adj", lambda a: a["id"]).alias("links"))
    assert ranks(graph.pagerank_step(start, graph.edges_of(links))) == {1: 0.2, 2: 0.25, 3: 0.55}


def test_two_phase_one_round(spark):
    found = graph.pagerank_two_phase(ones(spark, [1, 2, 3]), edges(spark, DEAD_END), 3, 1)
    assert ranks(found.df) == {1: 0.333333, 2: 0.758333, 3: 1.608333} and found.history == [2.0]


def test_two_phase_three_rounds(spark):
    found = graph.pagerank_two_phase(ones(spark, [1, 2, 3]), edges(spark, DEAD_END), 3, 3, "none")
    assert ranks(found.df) == {1: 0.525134, 2: 0.776179, 3: 1.398686}
    assert [round(m, 6) for m in found.history] == [2.0, 1.091667, 1.323056]


def test_two_phase_converges(spark):
    found = graph.pagerank_two_phase(ones(spark, [1, 2, 3]), edges(spark, DEAD_END), 3, 50)
    assert found.converged and found.iterations == 9
    assert ranks(found.df) == {1: 0.533457, 2: 0.760159, 3: 1.406385}


def test_two_phase_without_dead_ends_takes_three_rounds(spark):
    found = graph.pagerank_two_phase(ones(spark, [1, 2, 3]), edges(spark, DEAD_END | {3: [1]}), 3, 50)
    assert found.iterations == 3 and ranks(found.df) == {1: 0.918062, 2: 0.671031, 3: 1.110906}


def test_targets_become_nodes_in_one_form_only(spark):
    e, start = edges(spark, {1: [2, 9], 2: [1]}), ones(spark, [1, 2])
    assert ranks(graph.pagerank_two_phase(start, e, 2, 1).df) == {1: 0.925, 2: 0.5, 9: 0.5}
    assert set(ranks(graph.pagerank_vertex(start, e, 1).df)) == {1, 2}


def test_vertex_form_agrees_with_two_phase(spark):
    e, start = edges(spark, DEAD_END), ones(spark, [1, 2, 3])
    assert ranks(graph.pagerank_vertex(start, e, 3, tolerance=None).df) == {1: 0.525134, 2: 0.776179, 3: 1.398686}
    assert graph.pagerank_vertex(start, e, 100).converged


def test_simple_form_with_text_ids(spark):
    nodes = parse_text_graph(spark.createDataFrame([("a b c",), ("b c",), ("c a",), ("",)], "value string"))
    found = graph.pagerank_simple(nodes, graph.edges_of(nodes))
    assert found.converged and abs(sum(ranks(found.df).values()) - 1) < 1e-5


def test_link_graph_lines_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("1 1.0 2 3 ",), ("2\t0.5\t3",), ("3 1",), ("",)], "value string")
    nodes = parse_link_graph(lines)
    want = [(1, 1.0, [2, 3]), (2, 0.5, [3]), (3, 1.0, [])]
    assert sorted(map(tuple, nodes.collect())) == want
    write_graph(nodes, str(tmp_path / "g"))
    assert sorted(map(tuple, parse_link_graph(spark.read.text(str(tmp_path / "g"))).collect())) == want


@pytest.fixture
def roads(spark):
    return spark.createDataFrame([(1, 2, 5), (1, 3, 1), (2, 4, 1), (3, 2, 1), (4, 1, 1)], "src long, dst long, w long")


def test_relaxation(spark, roads):
    state = spark.createDataFrame([(1, 0), (2, -1), (3, -1), (4, -1), (5, -1)], "id long, dist long")
    for want in ({1: 0, 2: 5, 3: 1, 4: -1, 5: -1}, {1: 0, 2: 2, 3: 1, 4: 6, 5: -1}, {1: 0, 2: 2, 3: 1, 4: 3, 5: -1}):
        state = graph.bfs_step(state, roads)
        assert {r["id"]: r["dist"] for r in state.collect()} == want


def test_shortest_paths(spark, roads):
    start = spark.createDataFrame([(1, 0), (2, -1), (3, -1), (4, -1)], "id long, dist long")
    found = graph.sssp(start, roads)
    dist = {r["id"]: r["dist"] for r in found.df.collect()}
    assert found.converged and dist == {1: 0, 2: 2, 3: 1, 4: 3}
    assert all(dist[r["dst"]] <= dist[r["src"]] + r["w"] for r in roads.collect())


def test_in_links(spark, rows):
    lines = spark.createDataFrame([("1 1.0 B b",), ("2 1.0 c",), ("3 1.0",)], "value string")
    assert rows(graph.line_in_links(lines)) == [("b", 2), ("c", 1)]
    assert rows(graph.in_links(edges(spark, DEAD_END))) == [(2, 1), (3, 2)]


def test_empty_graph(spark):
    e, start = edges(spark, {}), ones(spark, [])
    assert ranks(graph.pagerank_step(start, e)) == {}
    assert graph.sssp(start.select("id", F.lit(0).alias("dist")), e.withColumn("w", F.lit(1))).df.count() == 0
