"""Counts of terms and means by key.

All variants with combining - by record, by task, by an explicit combiner - are one plan here:
Spark aggregates partially before the shuffle and spills instead of growing a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import exploded


def term_counts(lines: DataFrame, mode: str = "alnum", text_col: str = "value", partitions: int | None = None) -> DataFrame:
    """(term, n). ``partitions``: of the result, if other than the session's."""
    counts = exploded(lines, text_col, mode).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # the counts are dealt anew, one row a term: rows that a task has combined before the first shuffle
    return counts.repartition(partitions, "term") if partitions else counts


def mean_by_key(rows: DataFrame, key: str | Column = "key", value: str | Column = "v") -> DataFrame:
    """(key, mean): mean of integers, cut towards zero."""
    k = F.col(key) if isinstance(key, str) else key
    v = F.col(value) if isinstance(value, str) else value
    sums = rows.select(k.alias("key"), v.cast("long").alias("v")).groupBy("key").agg(F.sum("v").alias("s"), F.count("v").alias("c"))
    return sums.select("key", F.expr("s div c").alias("mean"))


def by_residue(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` in ``n`` partitions, a row in the one that its integer key leaves as rest."""
    return rows.repartitionById(n, F.pmod(F.col(key), F.lit(n)).cast("int"))
