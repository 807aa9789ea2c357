"""Joins to one row a key where some keys stand on very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with one row in so many are at most that many, whatever the input.
HOT_SHARE = 1024


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups`` (one row for each ``key``) with no hot key.

    ``size``: how many of ``rows`` have the key, or a bound in proportion. Groups with at least one
    row in ``HOT_SHARE`` are at most ``HOT_SHARE``, so they are broadcast, and their rows need no
    partner; rows of other keys are joined by key and ``spread`` deals the answered ones evenly.
    The columns of ``groups`` other than ``key`` and ``size`` are added."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    added = [c for c in groups.columns if c not in (key, size)]
    payload = F.struct(F.lit(True).alias("_found"), *added)
    hot = groups.where(F.col(size) * HOT_SHARE >= total).select(F.col(key).alias("_hot_key"), payload.alias("_hot"))
    cold = groups.where(F.col(size) * HOT_SHARE < total).select(F.col(key).alias("_key"), F.lit(0).alias("_part"), payload.alias("_cold"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    # an answered row goes to a part that no group has
    part = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(1 << 30)).cast("int") + 1)
    found = found.withColumns({"_part": part, "_key": F.col(key)})
    group = F.coalesce("_hot", "_cold")
    joined = found.join(cold, ["_key", "_part"], "left").withColumn("_group", group)
    if how == "inner":
        joined = joined.where("_group IS NOT NULL")
    return joined.select(*rows.columns, *[F.col("_group")[c].alias(c) for c in added])
