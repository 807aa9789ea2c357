"""PageRank in four forms, and shortest paths.

Structure (``edges``: src, dst, and their share 1 / outdegree) is computed once and written once;
each round moves (id, rank) only. Rounds end in the shared folder, so lineage stays short and a
lost executor costs one round at most."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import persist_observed, persist_table

#: The jump probability of the two-phase form is a 32-bit number.
ALPHA = 0.15000000596046448


@dataclass
class Result:
    df: DataFrame
    iterations: int
    converged: bool
    history: list[float] = field(default_factory=list)


def edges_of(nodes: DataFrame, links: str = "links") -> DataFrame:
    """(src, dst) of nodes with an array of targets."""
    return nodes.select(F.col("id").alias("src"), F.explode(links).alias("dst"))


def with_shares(edges: DataFrame) -> DataFrame:
    """(src, dst, share): the part of its rank that src sends along each of its edges."""
    degree = edges.groupBy("src").agg((1 / F.count(F.lit(1))).alias("share"))
    return edges.join(degree, "src")


def sent(ranks: DataFrame, shares: DataFrame) -> DataFrame:
    """(id, p): rank that arrives at each target. Targets with many in-links are summed before the shuffle."""
    moved = shares.join(ranks.select(F.col("id").alias("src"), "pr"), "src")
    return moved.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") * F.col("share")).alias("p"))


def pagerank_step(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """One step without jumps: (id, pr), 0 where nothing arrives."""
    return ranks.select("id").join(sent(ranks, with_shares(edges)), "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("pr"))


def _update(p: Column, alpha: float, n: int, missing: float) -> Column:
    return F.lit(alpha / n) + F.lit(1 - alpha) * (p + F.lit(missing / n))


def total_mass(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """(mass): what all nodes together send."""
    return sent(ranks, with_shares(edges)).agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("mass"))


def pagerank_two_phase(
    ranks: DataFrame,
    edges: DataFrame,
    n: int,
    iterations: int,
    convergence: str = "mass",
    alpha: float = ALPHA,
    tolerance: float = 0.001,
) -> Result:
    """Phase 1 sends ranks (targets that are no nodes become nodes, nodes without in-links get 0)
    and sums them; phase 2 spreads the missing mass n - sum evenly and adds the jump alpha / n.

    Ranks start as given, so with ranks of 1 they add up to alpha + (1 - alpha) * n.
    ``convergence="mass"`` stops once two sums in a row differ by less than ``tolerance``, which
    is looked at before a round and from the third round on; ``"none"`` never stops early."""
    shares = persist_table(with_shares(edges), "pagerank-edges")
    state, masses, before = ranks.select("id", F.col("pr").cast("double")), [], 0.0
    for i in range(iterations):
        if convergence == "mass" and before and abs(before - masses[-1]) < tolerance:
            return Result(state, i, True, masses)
        before = masses[-1] if masses else 0.0
        p = state.select("id").join(sent(state, shares), "id", "full_outer").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))
        p, seen = persist_observed(p, "pagerank", mass=F.sum("p"))
        masses.append(seen["mass"] or 0.0)
        state = p.select("id", _update(F.col("p"), alpha, n, n - masses[-1]).alias("pr"))
    return Result(state, iterations, False, masses)


def pagerank_vertex(ranks: DataFrame, edges: DataFrame, updates: int, alpha: float = ALPHA, tolerance: float | None = 0.0001) -> Result:
    """The same update with the given nodes only: rank sent to others is lost, counts as missing
    and is spread. Stops after the second update once the sum of changes is below ``tolerance``."""
    shares = persist_table(with_shares(edges), "vertex-edges")
    state = persist_table(ranks.select("id", F.col("pr").cast("double")), "vertex")
    n = state.count()
    changes: list[float] = []
    for i in range(updates):
        p = state.join(sent(state, shares), "id", "left").select("id", F.col("pr").alias("old"), F.coalesce("p", F.lit(0.0)).alias("p"))
        p, seen = persist_observed(p, "vertex", mass=F.sum("p"))
        missing = n - (seen["mass"] or 0.0)
        new = p.select("id", "old", _update(F.col("p"), alpha, n, missing).alias("pr"))
        state = new.select("id", "pr")
        if tolerance is not None:
            changes.append(new.agg(F.sum(F.abs(F.col("pr") - F.col("old")))).first()[0] or 0.0)
            if i >= 2 and changes[-1] < tolerance:
                return Result(state, i + 1, True, changes)
    return Result(state, updates, False, changes)


def pagerank_simple(nodes: DataFrame, edges: DataFrame, updates: int = 1000, alpha: float = 0.15, tolerance: float | None = 0.0001) -> Result:
    """Ranks from 1 / n, jump alpha / n, rank of dead ends is lost; stops after the second update
    once the mean change is below ``tolerance``. Ids may be of any type."""
    shares = persist_table(with_shares(edges), "simple-edges")
    n = nodes.count()
    state = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("pr"))
    changes: list[float] = []
    for i in range(updates):
        new = state.join(sent(state, shares), "id", "left").select(
            "id", F.col("pr").alias("old"), (F.lit(alpha / n) + F.lit(1 - alpha) * F.coalesce("p", F.lit(0.0))).alias("pr")
        )
        new, seen = persist_observed(new, "simple", change=F.avg(F.abs(F.col("pr") - F.col("old"))))
        state = new.select("id", "pr")
        if tolerance is not None:
            changes.append(seen["change"] or 0.0)
            if i >= 2 and changes[-1] < tolerance:
                return Result(state, i + 1, True, changes)
    return Result(state, updates, False, changes)


def change(new: DataFrame, old: DataFrame) -> DataFrame:
    """(total, mean) of absolute changes of ranks."""
    d = F.abs(F.col("pr") - F.col("old"))
    return new.join(old.select("id", F.col("pr").alias("old")), "id").agg(F.sum(d).alias("total"), F.avg(d).alias("mean"))


def _relaxed(dist: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, old, dist)."""
    reached = dist.where("dist >= 0").select(F.col("id").alias("src"), "dist")
    near = edges.join(reached, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("near"))
    own = F.when(F.col("dist") >= 0, F.col("dist"))
    new = F.coalesce(F.least(own, "near"), F.lit(-1)).cast("long")
    return dist.join(near, "id", "left").select("id", F.col("dist").alias("old"), new.alias("dist"))


def bfs_step(dist: DataFrame, edges: DataFrame) -> DataFrame:
    """One relaxation: (id, dist); -1 is not reached. ``edges``: src, dst, w."""
    return _relaxed(dist, edges).select("id", "dist")


def sssp(dist: DataFrame, edges: DataFrame, max_steps: int = 1000) -> Result:
    """``bfs_step`` until nothing changes."""
    edges = persist_table(edges.select("src", "dst", "w"), "sssp-edges")
    state = persist_table(dist.select("id", F.col("dist").cast("long")), "sssp")
    for i in range(max_steps):
        new, seen = persist_observed(_relaxed(state, edges), "sssp", changed=F.count_if(F.col("dist") != F.col("old")))
        state = new.select("id", "dist")
        if not seen["changed"]:
            return Result(state, i + 1, True)
    return Result(state, max_steps, False)


def in_links(edges: DataFrame) -> DataFrame:
    """(id, n): links to each target."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def line_in_links(lines: DataFrame) -> DataFrame:
    """(id, n) from graph lines: words from the third on, in lower case."""
    words = F.array_remove(F.split("value", r"\s+"), "")
    links = F.transform(F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), F.lower)
    return lines.select(F.explode(links).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
