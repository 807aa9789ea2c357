"""Sharding by a two-pass external shuffle.

Pass 1 measures the table and scatters every record into one of the buckets of its shard: the shard by
rendezvous hashing of (id, shard), the bucket within it by a seeded hash of id and content, both
uniform. A shard has as many buckets, a power of two, as bring its mean bucket down to
``bucket_bytes``, so a shard that holds most rows has most buckets. Rows equal in id and content
that together fill a quarter of a bucket are dealt by their place in the input as well. Pass 2 loads one
bucket at a time, brings it into a canonical order and permutes it with a seeded Fisher-Yates
shuffle, so a task that is run again writes the same.

Law ``key``: id and shard count alone decide the shard, and one shard more takes rows only into
itself, as a row moves only if the new shard's hash is the highest.

Defined results: a null text has no bytes; rows with a null id share one shard; the input's columns
travel as one struct ``record``, so their names clash with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..scratch import persist_table
from ..session import ship_package
from .common import small_side, table

SHARDS = 16


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is the highest."""
    score = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s"))
    )
    return F.array_max(score)["s"]


def buckets_of(held: int, bucket_bytes: int) -> int:
    n = 1
    while n * bucket_bytes < held:
        n *= 2
    return n


def _permuted(seed: int):
    def run(bucket: pa.Table) -> pa.Table:
        order = bucket.select(["id", "crc", "size"]).append_column("row", pa.array(np.arange(bucket.num_rows)))
        order = order.sort_by([("id", "ascending"), ("crc", "ascending"), ("size", "ascending")])["row"].to_numpy().copy()
        first = bucket.slice(0, 1)
        rng = np.random.default_rng([seed, first["shard"][0].as_py(), first["sub"][0].as_py()])
        rng.shuffle(order)  # Fisher-Yates
        out = bucket.take(pa.array(order))
        slot = pa.array(np.arange(out.num_rows) + first["offset"][0].as_py(), pa.int64())
        return out.select(["shard", "sub", "size", "crc", "record"]).append_column("slot", slot)

    return run


def shuffle_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = 32 << 20,
    seed: int = 17,
) -> DataFrame:
    """Rows: shard, slot (gapless from 0 within the shard), sub (bucket), size, crc, record."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).cast("long").alias("own"),
        F.crc32(text.cast("binary")).alias("crc"),
        rendezvous(F.col(id_col), shards, seed).alias("shard"),
        F.monotonically_increasing_id().alias("place"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
    ).withColumn("size", F.col("own") + 1)
    held = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.sum("size")).collect()}  # one row a shard
    buckets = F.array(*[F.lit(buckets_of(held.get(s, 0), bucket_bytes)) for s in range(shards)])
    same = rows.groupBy("id", "crc", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * F.col("size") * 4 >= bucket_bytes)
    same = persist_table(same.select(F.col("id").alias("id_"), F.col("crc").alias("crc_"), F.col("size").alias("size_")), "shards-same")
    n_same = same.count()
    place = F.lit(0).cast("long")
    if n_same:
        equal = F.col("id").eqNullSafe(F.col("id_")) & (F.col("crc") == F.col("crc_")) & (F.col("size") == F.col("size_"))
        rows = rows.join(small_side(same, n_same), equal, "left")
        place = F.when(F.col("size_").isNotNull(), F.col("place")).otherwise(place)
    sub = F.pmod(F.xxhash64(F.lit(seed + 1), "id", "crc", "size", place), F.element_at(buckets, F.col("shard") + 1))
    rows = rows.withColumn("sub", sub.cast("int")).select("id", "crc", "size", "shard", "sub", "record")
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "sub")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("sub", T.IntegerType()),
            T.StructField("size", T.LongType()),
            T.StructField("crc", T.LongType()),
            rows.schema["record"],
            T.StructField("slot", T.LongType()),
        ]
    )
    # the join deals the records by bucket, and the grouping uses the same partitions
    return rows.join(offsets, ["shard", "sub"]).groupBy("shard", "sub").applyInArrow(_permuted(seed), schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; files hold whole buckets in slot order."""
    (
        sharded.select("shard", "slot", "record.*")
        .write.partitionBy("shard")
        .mode("overwrite")
        .parquet(path)
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shuffle_shards(table(spark, sf_dir, "documents"))
    return sharded.select(
        "record.doc_id",
        "size",
        F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        rendezvous(F.col("record.doc_id"), SHARDS + 1, 17).alias("grown_shard"),
    )


QUERIES = {"op2_sharding": op2_sharding}
ORACLES: dict[str, str] = {}
