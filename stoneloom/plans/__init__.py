"""Named queries over the driver tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counting import term_counts
from ..sources import read_table
from . import clusters, grammars, graphs, pages, text

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent terms of the documents."""
    counts = term_counts(read_table(spark, sf_dir, "documents"), "alnum", "text")
    return counts.orderBy(F.desc("n"), "term").limit(20)


def queries() -> dict[str, Query]:
    return {k: f for m in (text, graphs, clusters, pages, grammars) for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in (text, graphs, clusters, pages, grammars) for k, s in m.ORACLES.items()}
