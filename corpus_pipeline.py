"""The corpus pipeline: quality classifier, exact dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet into the shared folder and hands the reread table to the next stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoneloom.llm.common import attach_groups, small_side, table
from stoneloom.llm.exact_dedup import first_of_each
from stoneloom.llm.minhash_dedup import near_duplicates
from stoneloom.llm.packing import digests, pack
from stoneloom.llm.quality import keep_good
from stoneloom.scratch import persist_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts, the one with the smallest id; ids need be neither unique nor there."""
    return first_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8 or more), the one with the
    smallest id. Rows are told apart by a number of their own, written with them, so ids need be
    neither unique nor there. Rows without words stay."""
    number = "row"
    while number in docs.columns:
        number += "_"
    docs = persist_table(docs.withColumn(number, F.monotonically_increasing_id()), "near-rows")
    found = near_duplicates(docs, percent=80, id_col=number).select(F.col(number).alias("row"), F.col("component_id").alias("c"))
    ids = docs.select(F.col(number).alias("row"), F.col("doc_id").alias("id"))
    found = persist_table(found.join(ids, "row"), "near-found")
    best = found.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = persist_table(best.where("n > 1").select("c", "n", F.col("best.row").alias("stays")), "near-best")
    grouped = attach_groups(found.select("row", "c"), best, "c", "n", "row")
    dropped = persist_table(grouped.where("group.stays <> row").select(F.col("row").alias(number)), "near-dropped")
    return docs.join(small_side(dropped, dropped.count()), number, "left_anti").drop(number)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    return digests(pack(docs))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
