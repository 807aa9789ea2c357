"""Operators of a training-data pipeline. Nothing else in the library imports this."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_stream, chat_format, exact_dedup, gru_lm, html_extract, minhash_dedup, packing, quality, sharding, topk_search

MODULES = [exact_dedup, sharding, topk_search, packing, bpe_stream, html_extract, chat_format, minhash_dedup, quality, gru_lm]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
