"""k-means over the embeddings, started from ids modulo k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster
from ..sources import read_table
from .sql import materialized

K = 4
#: Rounds that ``kmeans_converged`` may take, and its tolerance.
SETTLED, SETTLING = 30, 0.01


def _points(spark: SparkSession, d: str) -> DataFrame:
    coords = F.transform("embedding", lambda x: x.cast("double"))
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), coords.alias("coords"))


def _first(points: DataFrame) -> tuple[DataFrame, dict[int, list[float]]]:
    run = cluster.kmeans(points, K, 1, init="modulo")
    return run.assignment, run.centroids


def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d)
    return cluster.assign(points, _first(points)[1]).select("point_id", "cluster")


def kmeans_centroids(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d)
    means = cluster.centroids_of(cluster.assign(points, _first(points)[1]), 64)
    return means.select("cluster", "size", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


def kmeans_outliers(spark: SparkSession, d: str) -> DataFrame:
    assigned, centroids = _first(_points(spark, d))
    return cluster.outliers(assigned, centroids, K - 1).select("cluster", "rank", "point_id", F.round("dist", 6).alias("dist"))


def kmeans_3iter(spark: SparkSession, d: str) -> DataFrame:
    return cluster.kmeans(_points(spark, d), K, 3, init="modulo", tolerance=-1.0).assignment.select("point_id", "cluster")


def kmeans_reseed(spark: SparkSession, d: str) -> DataFrame:
    """Five clusters of which two start empty: they take the farthest points of the largest."""
    run = cluster.kmeans(_points(spark, d), 5, 2, init=F.col("point_id") % 3, tolerance=-1.0)
    return run.assignment.select("point_id", "cluster")


def kmeans_converged(spark: SparkSession, d: str) -> DataFrame:
    """(iterations, converged, cluster, size) when no coordinate moves by more than the tolerance."""
    run = cluster.kmeans(_points(spark, d), K, SETTLED, init="modulo", tolerance=SETTLING)
    rows = [(run.iterations, run.converged, i, n) for i, n in sorted(run.sizes.items())]
    return spark.createDataFrame(rows, "iterations int, converged boolean, cluster int, size long")


QUERIES = {
    "kmeans_assign": kmeans_assign,
    "kmeans_centroids": kmeans_centroids,
    "kmeans_outliers": kmeans_outliers,
    "kmeans_3iter": kmeans_3iter,
    "kmeans_reseed": kmeans_reseed,
    "kmeans_converged": kmeans_converged,
}


def _means(i: int) -> str:
    return (
        f", l{i} AS (SELECT cluster, dim, avg(c[dim]) AS value FROM (SELECT cluster, c, unnest(generate_series(1, 64)) AS dim FROM a{i}) GROUP BY 1, 2)"
        f", c{i} AS (SELECT cluster AS idx, list(value ORDER BY dim) AS m FROM l{i} GROUP BY cluster)"
    )


def _assign(i: int) -> str:
    return (
        f", a{i} AS (SELECT point_id, c, CAST(arg_min(idx, (list_distance(c, m), idx)) AS INTEGER) AS cluster FROM p, c{i - 1} GROUP BY point_id, c)"
    )


_P = (
    "WITH p AS (SELECT vec_id AS point_id, CAST(embedding AS DOUBLE[]) AS c FROM embeddings)"
    f", a0 AS (SELECT point_id, c, CAST(point_id % {K} AS INTEGER) AS cluster FROM p)"
)
ORACLES = {
    "kmeans_assign": _P + _means(0) + _assign(1) + " SELECT point_id, cluster FROM a1",
    "kmeans_centroids": _P
    + _means(0)
    + _assign(1)
    + _means(1)
    + " SELECT cluster, (SELECT count(*) FROM a1 WHERE a1.cluster = l1.cluster) AS size, CAST(dim - 1 AS INTEGER) AS dim, round(value, 6) AS value FROM l1",
    "kmeans_outliers": _P
    + _means(0)
    + f", d AS (SELECT cluster, point_id, list_distance(c, m) AS dist FROM a0 JOIN c0 ON cluster = idx)"
    f", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY dist DESC, point_id) AS INTEGER) AS rank FROM d)"
    f" SELECT cluster, rank, point_id, round(dist, 6) AS dist FROM r WHERE rank <= {K - 1}",
    "kmeans_3iter": _P + _means(0) + _assign(1) + _means(1) + _assign(2) + " SELECT point_id, cluster FROM a2",
    "kmeans_reseed": _P.replace(f"point_id % {K}", "point_id % 3")
    + _means(0).replace("c0 AS", "c0some AS")
    + ", top AS (SELECT arg_max(cluster, (n, -cluster)) AS cluster FROM (SELECT cluster, count(*) AS n FROM a0 GROUP BY cluster))"
    + ", far AS (SELECT c, row_number() OVER (ORDER BY list_distance(c, m) DESC, point_id) AS rank FROM a0 JOIN top USING (cluster) JOIN c0some ON idx = cluster)"
    + ", c0 AS (SELECT idx, m FROM c0some UNION ALL SELECT rank + 2, c FROM far WHERE rank <= 2)"
    + _assign(1)
    + " SELECT point_id, cluster FROM a1",
    "kmeans_converged": materialized(
        _P + _means(0)
    + "".join(_assign(i) + _means(i) for i in range(1, SETTLED))
    + ", moved AS (" + " UNION ALL ".join(
        f"SELECT {i + 1} AS i, max(abs(a.value - b.value)) AS d FROM l{i} a JOIN l{i - 1} b USING (cluster, dim)" for i in range(1, SETTLED)
    ) + ")"
    + f", stop AS (SELECT min(i) AS i FROM moved WHERE d <= {SETTLING})"
    + ", sizes AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS i, cluster, count(*) AS size FROM a{i} GROUP BY cluster" for i in range(SETTLED)) + ")"
    + " SELECT CAST(i AS INTEGER) AS iterations, true AS converged, cluster, size FROM sizes JOIN stop USING (i)"
    ),
}
