"""k-means with empty clusters filled by outliers of the largest.

Points stay where they are: each round assigns them against k centroids (k * d numbers, one literal
of the plan) and aggregates means by cluster and slice of coordinates before the shuffle."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import distance

TOLERANCE = 0.01


@dataclass
class Clusters:
    """assignment: (point_id, coords, cluster); centroids by index, missing ones are empty."""

    assignment: DataFrame
    centroids: dict[int, list[float]]
    sizes: dict[int, int]
    iterations: int
    converged: bool
    history: list[dict[int, list[float]]] = field(default_factory=list)


#: Coordinates of one slice.
SLICE = 32


def initial(points: DataFrame, k: int, init: str | Column = "random", seed: int = 1) -> DataFrame:
    """A cluster for every point: by a seeded hash of its id, by its id modulo k, or by a column."""
    if isinstance(init, str):
        init = F.pmod(F.xxhash64(F.lit(seed), "point_id"), F.lit(k)) if init == "random" else F.pmod("point_id", F.lit(k))
    return points.withColumn("cluster", init.cast("int"))


def _literal(centroids: dict[int, list[float]]) -> Column:
    """Array of (idx, c) as one constant, whatever the number of centroids and coordinates."""
    listed = json.dumps([{"idx": i, "c": [float(x) for x in c]} for i, c in sorted(centroids.items())])
    return F.from_json(F.lit(listed), "array<struct<idx: int, c: array<double>>>")


def nearest(coords: Column, centroids: dict[int, list[float]]) -> Column:
    """(d, idx) of the nearest centroid, the lowest index among equals."""
    return F.array_min(F.transform(_literal(centroids), lambda m: F.struct(distance(coords, m["c"]).alias("d"), m["idx"].alias("idx"))))


def assign(points: DataFrame, centroids: dict[int, list[float]]) -> DataFrame:
    return points.withColumn("cluster", nearest(F.col("coords"), centroids)["idx"])


def centroids_of(assigned: DataFrame, dims: int) -> DataFrame:
    """(cluster, size, centroid): means by coordinate."""
    starts = F.lit(list(range(0, max(dims, 1), SLICE)))
    parts = assigned.select("cluster", "coords", F.explode(starts).alias("at")).select("cluster", "at", F.slice("coords", F.col("at") + 1, SLICE).alias("x"))
    means = F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(min(dims, SLICE))])
    parts = parts.groupBy("cluster", "at").agg(F.count(F.lit(1)).alias("size"), means.alias("means"))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "means"))), lambda p: p["means"]))
    return parts.groupBy("cluster").agg(F.max("size").alias("size"), F.slice(whole, 1, dims).alias("centroid"))


def outliers(assigned: DataFrame, centroids: dict[int, list[float]], n: int) -> DataFrame:
    """(cluster, rank, point_id, dist, coords): the n farthest points of each cluster, first ids first among equals."""
    at = F.try_element_at(F.map_from_entries(_literal(centroids)), F.col("cluster"))
    far = assigned.withColumn("dist", distance(F.col("coords"), at))
    order = Window.partitionBy("cluster").orderBy(F.desc("dist"), "point_id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("cluster", "rank", "point_id", "dist", "coords")


def largest(sizes: dict[int, int]) -> int:
    """The lowest index among the largest clusters."""
    return max(sizes, key=lambda i: (sizes[i], -i))


def reseeded(assigned: DataFrame, centroids: dict[int, list[float]], sizes: dict[int, int], k: int) -> dict[int, list[float]]:
    """Centroids with the j-th empty cluster at the j-th farthest point of the largest."""
    empty = [i for i in range(k) if i not in centroids]
    if not empty or not centroids:
        return centroids
    top = largest(sizes)
    own = assigned.where(F.col("cluster") == top)
    found = outliers(own, centroids, k - 1).orderBy("rank").collect()
    return centroids | {i: list(row["coords"]) for i, row in zip(empty, found, strict=False)}


def moved(a: dict[int, list[float]], b: dict[int, list[float]]) -> float:
    return max((abs(x - y) for i in a for x, y in zip(a[i], b[i], strict=True)), default=0.0)


def kmeans(points: DataFrame, k: int, iterations: int, init: str | Column = "random", seed: int = 1, tolerance: float = TOLERANCE) -> Clusters:
    """``points``: point_id, coords (array of double). Converged when no coordinate of a centroid
    moves by more than ``tolerance``; never in the first round, nor with an empty cluster."""
    width = points.select(F.max(F.size("coords"))).first()[0] or 0
    assigned = initial(points, k, init, seed)
    history: list[dict[int, list[float]]] = []
    centroids: dict[int, list[float]] = {}
    sizes: dict[int, int] = {}
    for i in range(iterations):
        if i:
            assigned = assign(points, reseeded(assigned, centroids, sizes, k))
        rows = centroids_of(assigned, width).collect()
        before, centroids = centroids, {r["cluster"]: list(r["centroid"]) for r in rows}
        sizes = {r["cluster"]: r["size"] for r in rows}
        history.append(centroids)
        if i and len(centroids) == k and len(before) == k and moved(before, centroids) <= tolerance:
            return Clusters(assigned, centroids, sizes, i + 1, True, history)
    return Clusters(assigned, centroids, sizes, iterations, False, history)


def sum_of_squares(assigned: DataFrame, centroids: dict[int, list[float]]) -> float:
    d = nearest(F.col("coords"), centroids)["d"]
    return assigned.agg(F.sum(d * d)).first()[0] or math.nan
