"""Exact top-k search by tiled matrix products.

Candidates are dealt into shards of about ``shard_rows`` vectors and queries into blocks of
about ``block_rows`` by hashes of their ids, candidates by their place in the input too, as a row may
be repeated very often. A tile is one shard with one block; each side is
repeated once for every tile it belongs to, so a task holds one shard and one block at most,
and the traffic per product falls with the tile's edge. A tile is one matrix product and a
partial selection that keeps ``k`` rows of a query. The lists of a query are merged by a tree of
fan-in ``FAN_IN``: no merge sees more than ``FAN_IN * k`` rows.

Products are exact: floating-point products of integers are used only while every partial sum
fits 53 bits, 64-bit integers up to 63 bits, Python integers (result held to the range of a
long) beyond.

Defined results: vectors that are null or hold a null or non-finite component take no part;
vectors of different length are not compared; equal query rows (id and vector) count once,
repeated candidate rows each count; where one id has several query vectors their lists are
merged; ties go to the smaller id. Rows without an id take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import table

FAN_IN = 64
LIMIT = (1 << 63) - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector may not take part."""
    clean = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(clean, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(side: pa.Table, ids: str, vectors: str) -> tuple[np.ndarray, list[np.ndarray]]:
    lists = side[vectors].combine_chunks()
    starts = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    return side[ids].to_numpy(), [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q and of c."""
    peak = [int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) for x in (q, c)]
    bound = peak[0] * peak[1] * max(1, q.shape[1])
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound <= LIMIT:
        return q @ c.T
    big = q.astype(object) @ c.astype(object).T
    return np.clip(big, -LIMIT, LIMIT).astype(np.int64)


def _tile(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int64())])

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if candidates.num_rows and queries.num_rows:
            shard = candidates["shard"][0].as_py()
            c_ids, c_rows = _matrix(candidates.sort_by("vec_id"), "vec_id", "v")
            q_ids, q_rows = _matrix(queries, "query_id", "q_v")
            c_len, q_len = (np.array([len(r) for r in rows]) for rows in (c_rows, q_rows))
            for dim in np.intersect1d(c_len, q_len):
                ci, qi = np.flatnonzero(c_len == dim), np.flatnonzero(q_len == dim)
                ids = c_ids[ci]
                c = np.stack([c_rows[i] for i in ci])
                for at in range(0, len(qi), 256):  # a strip of scores at a time
                    part = qi[at : at + 256]
                    scores = products(np.stack([q_rows[i] for i in part]), c)
                    for query, row in zip(q_ids[part], scores, strict=True):
                        free = np.flatnonzero(ids != query)
                        row = row[free]
                        if len(row) > k:
                            least = np.partition(row, len(row) - k)[len(row) - k]
                            over = np.flatnonzero(row > least)
                            # ids ascend, so the first of the equal ones are the smallest
                            best = np.concatenate([over, np.flatnonzero(row == least)[: k - len(over)]])
                        else:
                            best = np.arange(len(row))
                        out.append((np.full(len(best), query), ids[free[best]], row[best], np.full(len(best), shard)))
        columns = [np.concatenate(x) if out else np.array([], np.int64) for x in (zip(*out, strict=True) if out else [()] * 4)]
        return pa.table([pa.array(x, pa.int64()) for x in columns], schema=schema)

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 4096,
    block_rows: int = 2048,
) -> DataFrame:
    """The k best of all other rows for every row where ``is_query``: query_id, rank, vec_id, score."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v"), is_query.alias("q")
    ).where("vec_id IS NOT NULL AND v IS NOT NULL")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))

    def part(seed: int, n: int, *more: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v", *more), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    candidates = rows.select("vec_id", "v", part(1, shards, F.monotonically_increasing_id()).alias("shard"), every(blocks).alias("block"))
    queries = rows.where("q").select("vec_id", "v").dropDuplicates()
    queries = queries.select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q_v"), part(2, blocks).alias("q_block"), every(shards).alias("q_shard")
    )
    lists = (
        candidates.groupBy("shard", "block")
        .cogroup(queries.groupBy("q_shard", "q_block"))
        .applyInArrow(_tile(k), "query_id long, vec_id long, score long, shard long")
    )
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))), 1, k)
    while True:
        lists = lists.withColumn("shard", F.expr(f"shard div {FAN_IN}")).groupBy("query_id", "shard").agg(best.alias("best"))
        shards = -(-shards // FAN_IN)
        if shards == 1:
            break
        lists = lists.select("query_id", "shard", F.inline("best")).select(
            "query_id", F.col("v").alias("vec_id"), (-F.col("s")).alias("score"), "shard"
        )
    return lists.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score")
    )


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op3_topk_search": op3_topk_search}
ORACLES = {
    "op3_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
}
