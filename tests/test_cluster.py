from __future__ import annotations

from pyspark.sql import functions as F

from stoneloom.functions.vectors import add, close, distance, divide, first_difference, order
from stoneloom.operators import cluster
from stoneloom.sources import parse_points


def points(spark, xs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "point_id long, coords array<double>")


def assignment(found):
    return [r["cluster"] for r in found.assignment.orderBy("point_id").collect()]


def test_converges_in_three_rounds(spark, monkeypatch):
    first = spark.createDataFrame(list(enumerate([0, 0, 0, 0, 1])), "point_id long, cluster int")
    monkeypatch.setattr(cluster, "initial", lambda p, k, init, seed: p.join(first, "point_id"))
    found = cluster.kmeans(points(spark, [(0, 0), (0, 2), (10, 0), (10, 2), (1, 1)]), 2, 10)
    assert assignment(found) == [1, 1, 0, 0, 1] and found.converged and found.iterations == 3
    assert {i: [round(x, 6) for x in c] for i, c in found.centroids.items()} == {0: [10.0, 1.0], 1: [0.333333, 1.0]}


def test_empty_cluster_takes_an_outlier_of_the_largest(spark, monkeypatch):
    monkeypatch.setattr(cluster, "initial", lambda p, k, init, seed: p.withColumn("cluster", F.lit(0)))
    found = cluster.kmeans(points(spark, [(0, 0), (0, 1), (9, 9), (9, 8)]), 2, 10)
    assert found.history[0] == {0: [4.5, 4.5]}
    assert assignment(found) == [1, 1, 0, 0] and found.iterations == 3
    assert found.centroids == {0: [9.0, 8.5], 1: [0.0, 0.5]}


def test_error_never_rises(spark):
    p = points(spark, [(i % 7, (i * i) % 11) for i in range(60)])
    run = cluster.kmeans(p, 3, 6, init="modulo", tolerance=-1.0)
    errors = [cluster.sum_of_squares(p, c) for c in run.history]
    assert all(a >= b - 1e-9 for a, b in zip(errors, errors[1:], strict=False))


def test_ties_go_to_the_lower_index_and_random_start_repeats(spark):
    p = points(spark, [(0, 0)])
    assert cluster.assign(p, {1: [1.0, 0.0], 0: [-1.0, 0.0]}).first()["cluster"] == 0
    many = points(spark, [(i, i) for i in range(50)])
    a, b = (cluster.initial(many, 3).orderBy("point_id").collect() for _ in range(2))
    assert a == b and {r["cluster"] for r in a} == {0, 1, 2}


def test_largest_and_outliers(spark, rows):
    assert cluster.largest({0: 2, 1: 5, 2: 5}) == 1
    p = points(spark, [(0,), (5,), (5,), (1,)]).withColumn("cluster", F.lit(0))
    far = cluster.outliers(p, {0: [0.0]}, 2)
    assert rows(far, "rank", "point_id") == [(1, 1), (2, 2)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], None)], "a array<double>, b array<double>, c array<double>")
    row = df.select(
        distance(F.col("a"), F.col("b")).alias("d"),
        (distance(F.col("a"), F.col("c")) > 1e300).alias("far"),
        add(F.col("a"), F.col("a")).alias("s"),
        divide(F.col("a"), F.lit(2.0)).alias("h"),
        first_difference(F.col("a"), F.col("b"), 3.5).alias("f"),
        close(F.col("a"), F.col("b"), 4.0).alias("c"),
    ).first()
    assert tuple(row) == (5.0, True, [6.0, 8.0], [1.5, 2.0], 4.0, True)


def test_points_of_words(spark):
    lines = spark.createDataFrame([("1.5 red 2 NaNa -3e1",), ("",)], "value string")
    assert [tuple(r) for r in parse_points(lines).collect()] == [([1.5, 2.0, -30.0], ["red", "NaNa"]), ([], [])]


def test_order_of_points(spark):
    pairs = [([1.0, 2.0], [1.0, 3.0], -1), ([2.0], [1.0, 9.0], 1), ([1.0], [1.0, 0.0], -1), ([1.0, 2.0], [1.0, 2.0], 0)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, want int")
    assert all(r["got"] == r["want"] for r in df.select(order(F.col("a"), F.col("b")).alias("got"), "want").collect())
