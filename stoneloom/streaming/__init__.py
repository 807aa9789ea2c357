"""Counts that keep up with files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.counting import term_counts


def stream_term_counts(spark: SparkSession, path: str, mode: str = "alnum") -> DataFrame:
    """Streaming (term, n) over text files in ``path``; write it in complete or update mode."""
    return term_counts(spark.readStream.text(path), mode)
