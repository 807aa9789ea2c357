"""Counters of a job, taken while its rows pass by.

Observed metrics come with the action that writes the rows, need no pass of their own and are not
counted twice when a task is run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``df``, and an observation whose ``get`` has ``rows`` and the rows of each condition, after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen
