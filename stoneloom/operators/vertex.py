"""Vertex programs: supersteps of send, combine, compute until every vertex rests.

A superstep is one join of the state with the edges (send to neighbours), one aggregation by
target (combine; partial before the shuffle, so a vertex with many in-links is no hot key) and one
left join back (messages to missing vertices are lost). It ends at a barrier: the new state is
written to the shared folder. Global aggregators are one-row aggregations over the state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import persist_observed, persist_table


@dataclass
class VertexProgram:
    """``message``: what a vertex sends along an edge, over columns of its state and of the edge.
    ``combine``: aggregate of arriving messages. ``compute``: new value over the old ``value`` and
    the combined ``message`` (null if none came), and the aggregators of the superstep before.
    ``sends``: which vertices send. ``aggregates``: one number each, over ``value`` and ``old``.
    ``rests``: halting test over superstep and aggregators; by default until no value changes."""

    message: Column
    combine: Callable[[Column], Column]
    compute: Callable[[int, dict[str, float]], Column]
    sends: Column | None = None
    aggregates: dict[str, Column] | None = None
    rests: Callable[[int, dict[str, float]], bool] | None = None


@dataclass
class VertexResult:
    df: DataFrame
    supersteps: int
    halted: bool
    aggregated: list[dict[str, float]]


def run(program: VertexProgram, vertices: DataFrame, edges: DataFrame, max_supersteps: int = 1000) -> VertexResult:
    """``vertices``: id, value. ``edges``: src, dst, and what ``message`` reads."""
    edges = persist_table(edges, "vertex-edges")
    state = persist_table(vertices.select("id", "value"), "vertex-state")
    wanted = dict(program.aggregates or {})
    changed = F.coalesce(F.sum((~F.col("value").eqNullSafe(F.col("old"))).cast("long")), F.lit(0))
    seen: list[dict[str, float]] = []
    for step in range(max_supersteps):
        sources = (state if program.sends is None else state.where(program.sends)).withColumnRenamed("id", "src")
        arrived = edges.join(sources, "src").select(F.col("dst").alias("id"), program.message.alias("m"))
        arrived = arrived.groupBy("id").agg(program.combine(F.col("m")).alias("message"))
        value = program.compute(step, seen[-1] if seen else {})
        new = state.join(arrived, "id", "left").select("id", F.col("value").alias("old"), value.alias("value"))
        new, row = persist_observed(new, "vertex-state", changed=changed, **wanted)
        seen.append(row)
        state = new.select("id", "value")
        if program.rests(step, seen[-1]) if program.rests else not seen[-1]["changed"]:
            return VertexResult(state, step + 1, True, seen)
    return VertexResult(state, max_supersteps, False, seen)


def shortest_paths(source) -> tuple[VertexProgram, Callable[[DataFrame], DataFrame]]:
    """Distances from ``source`` along edges with ``w``; null is not reached. The second function
    makes the vertices from (id)."""
    program = VertexProgram(
        message=F.col("value") + F.col("w"),
        combine=F.min,
        compute=lambda step, seen: F.least("value", "message"),
        sends=F.col("value").isNotNull(),
    )
    return program, lambda ids: ids.select("id", F.when(F.col("id") == source, 0).cast("long").alias("value"))


def largest_value() -> VertexProgram:
    """Every vertex learns the largest value that can reach it."""
    return VertexProgram(message=F.col("value"), combine=F.max, compute=lambda step, seen: F.greatest("value", "message"))
