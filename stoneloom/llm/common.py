"""Table access, joins to groups and components for the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import persist_table

#: White space of the contracts: blank and the controls 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A side of a join may be sent to every task up to so many rows of a few longs; beyond, it is shuffled.
BROADCAST_ROWS = 1 << 18
#: Groups with one row in so many are at most that many, whatever the input.
HOT_SHARE = 1024


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its checked number of rows is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """Left join of every row to its group by ``key``, with no hot key.

    Groups with at least one row in ``HOT_SHARE`` are broadcast and their rows dealt by
    ``spread``; any other key has fewer rows than that share. Keys are longs or binary. The
    group's columns other than ``key`` come as struct ``group``."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    payload = F.struct(*[c for c in groups.columns if c != key])
    hot = groups.where(F.col(size) * HOT_SHARE >= total).select(F.col(key).alias("_hot_key"), payload.alias("_hot"))
    cold = groups.select(F.col(key).alias("_key"), payload.alias("_cold"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    # an answered row needs no partner; should its new key be some group's, the broadcast answer still comes first
    free = F.xxhash64(F.col(spread))
    free = free if rows.schema[key].dataType == T.LongType() else F.unhex(F.hex(free))
    found = found.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(free))
    return found.join(cold, "_key", "left").select(*rows.columns, F.coalesce("_hot", "_cold").alias("group"))


def followed(rows: DataFrame, key: str, roots: DataFrame, spread: str) -> DataFrame:
    """``rows`` with ``key`` replaced by its root in ``roots`` (node, root), where it has one.

    ``roots`` is broadcast if its checked number of rows is within the bound; beyond, it is joined
    with no hot key, however many rows share one."""
    if roots.count() <= BROADCAST_ROWS:
        to = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        found = rows.join(F.broadcast(to), F.col(key) == F.col("_node"), "left")
        return found.withColumn(key, F.coalesce("_root", key)).select(*rows.columns)
    sizes = rows.groupBy(F.col(key).alias("node")).agg(F.count(F.lit(1)).alias("_n"))
    groups = roots.join(sizes, "node").select(F.col("root").alias("_root"), "_n", F.col("node").alias(key))
    found = attach_groups(rows, groups, key, "_n", spread)
    return found.withColumn(key, F.coalesce("group._root", key)).select(*rows.columns)


#: Rounds of a contraction in the order of ids, which ends stars at once; later ones draw the order, which ends chains.
ROUNDS_BY_ID = 3


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); root is the smallest id reachable.

    Contraction: every node hooks itself to the least of itself and its neighbours; edges go
    between hooks then, loops and repeated ones fall away, until no edge is left. With orders
    drawn anew each round a quarter of the nodes goes in expectation, whatever the graph. Every
    round is written to the shared folder; a hub is no join key of many rows (``followed``)."""
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    now = persist_table(edges.select(low, high).where("u < v").distinct(), f"{label}-edges")
    levels: list[DataFrame] = []
    while True:
        drawn = len(levels) >= ROUNDS_BY_ID
        rank = (lambda c, seed=len(levels): F.xxhash64(F.lit(seed), c)) if drawn else F.col
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("other")).union(now.select("v", "u"))
        best = F.min(F.struct(rank("other").alias("rank"), F.col("other").alias("root")))
        hooks = ends.groupBy("node").agg(best.alias("best"))
        own = F.struct(rank("node").alias("rank"), F.col("node").alias("root"))
        hooks = persist_table(hooks.select("node", F.least(own, "best")["root"].alias("root")), f"{label}-hooks")
        levels.append(hooks)
        if not now.limit(1).count():
            break
        now = followed(followed(now, "u", hooks, "v"), "v", hooks, "u")
        now = persist_table(now.select(low, high).where("u < v").distinct(), f"{label}-edges")
    found = levels.pop()
    while levels:
        found = followed(levels.pop(), "root", found, "node")
        if levels:
            found = persist_table(found, f"{label}-levels")
    found = persist_table(found, label)
    least = found.groupBy("root").agg(F.min("node").alias("least")).where("least <> root")
    if drawn and least.limit(1).count():
        least = persist_table(least.select(F.col("root").alias("node"), F.col("least").alias("root")), f"{label}-least")
        found = persist_table(followed(found, "root", least, "node"), label)
    return found
