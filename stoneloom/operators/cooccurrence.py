"""Co-occurrence of words within a window of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import single_ws, single_ws_cased
from ..joins import attach
from ..scratch import persist_table

#: Words that only stood alone may be sent to every task up to so many bytes.
BROADCAST_BYTES = 1 << 24
#: Entries of stripes that one task gathers, about.
TASK_PAIRS = 1 << 19


def _side_by_side(tokens: Column, window: int) -> Column:
    """Array of (a, b): every two positions at most ``window`` apart, once."""

    def at(distance: int) -> Column:
        n = F.greatest(F.size(tokens) - distance, F.lit(0))
        return F.arrays_zip(F.slice(tokens, 1, n).alias("a"), F.slice(tokens, 1 + distance, n).alias("b"))

    return F.concat(*[at(d) for d in range(1, window + 1)])


def _pair_key(a: Column, b: Column) -> Column:
    """One text for two tokens in either order; tokens have no blanks, so a blank parts them."""
    return F.concat_ws(" ", F.least(a, b), F.greatest(a, b))


def _both_ways(counted: DataFrame) -> DataFrame:
    """(w, u, n) of pairs counted by ``_pair_key``: each in both orders, two equal tokens once and twice as often."""
    parts = counted.select(F.substring_index("pair", " ", 1).alias("a"), F.substring_index("pair", " ", -1).alias("b"), "n")
    equal = F.col("a") == F.col("b")
    turned = F.explode(F.when(equal, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("turned")
    sides = parts.select("a", "b", F.when(equal, 2 * F.col("n")).otherwise(F.col("n")).alias("n"), turned)
    return sides.select(F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("w"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("u"), "n")


def _pair_counts(lines: DataFrame, text_col: str, window: int) -> DataFrame:
    """(pair, n), in lower case. Neighbourhood is symmetric, so half of the pairs are counted, each by a single text."""
    tokens = lines.select(single_ws(F.col(text_col)).alias("t"))
    found = tokens.select(F.inline(_side_by_side(F.col("t"), window)).alias("a", "b"))
    return found.groupBy(_pair_key(F.col("a"), F.col("b")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def pairs(lines: DataFrame, text_col: str = "value", window: int = 1) -> DataFrame:
    """(w, u, n), both in lower case: how often ``u`` stands at most ``window`` from ``w``."""
    return _both_ways(_pair_counts(lines, text_col, window))


def totals(lines: DataFrame, text_col: str = "value", window: int = 1) -> DataFrame:
    """``marginals`` of ``pairs`` without the pairs: the positions around each word that are on its line."""
    tokens = lines.select(single_ws(F.col(text_col)).alias("t"))
    placed = tokens.select(F.size("t").alias("size"), F.posexplode("t").alias("i", "w"))
    around = F.least(F.col("i"), F.lit(window)) + F.least(F.col("size") - 1 - F.col("i"), F.lit(window))
    return placed.where("size > 1").groupBy("w").agg(F.sum(around).alias("n"))


def stripes(lines: DataFrame, text_col: str = "value", window: int = 1, block_words: int = 1 << 16) -> DataFrame:
    """(w, block, stripe): maps from neighbour in lower case to count, for words as written. Neighbours are dealt
    into blocks by a hash, as many as bring a block of the whole vocabulary down to about ``block_words``, so no map grows
    with the corpus. Words that only stood alone have an empty map in block 0.

    Pairs are counted as written and in one order; both orders meet only in the exchange of the stripes."""
    tokens = lines.select(single_ws_cased(F.col(text_col)).alias("t"))
    # a word alone on its line is a text without a blank, which no pair is
    side = F.when(F.size("t") == 1, F.array(F.struct(F.col("t")[0].alias("a"), F.lit(None).cast("string").alias("b")))).otherwise(_side_by_side(F.col("t"), window))
    key = F.when(F.col("b").isNull(), F.col("a")).otherwise(_pair_key(F.col("a"), F.col("b")))
    found = tokens.select(F.inline(side).alias("a", "b")).groupBy(key.alias("pair"))
    counted = persist_table(found.agg(F.count(F.lit(1)).alias("n")), "stripes")
    paired = F.contains("pair", F.lit(" "))
    both = _both_ways(counted.where(paired)).withColumn("u", F.lower("u"))
    alone = counted.where(~paired).select(F.col("pair").alias("w"))
    near = both.select("w")
    if (alone.agg(F.sum(F.octet_length("w") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        near = near.join(F.broadcast(alone), "w", "left_semi")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    alone = alone.join(near.distinct(), "w", "left_anti").select("w", F.lit(0).alias("block"), empty.alias("stripe"))
    blocks = max(1, -(-both.agg(F.approx_count_distinct("u")).first()[0] // block_words))
    both = both.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int"))
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * counted.count() // TASK_PAIRS))
    merged = both.repartition(tasks, "w", "block").groupBy("w", "block", "u").agg(F.sum("n").alias("n"))
    found = merged.groupBy("w", "block").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("u", "n")))).alias("stripe"))
    return found.unionByName(alone)


def marginals(counted: DataFrame) -> DataFrame:
    """(w, n): neighbours of each word."""
    return counted.groupBy("w").agg(F.sum("n").alias("n"))


def with_marginals(counted: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """(w, u, n, is_marginal): counts, and a row for each word with its total. The flag, not a mark
    in ``u``, tells them apart, so no word collides with the mark. ``total``: the marginals, if they are at hand."""
    total = (marginals(counted) if total is None else total).select("w", F.lit(None).cast("string").alias("u"), "n", F.lit(True).alias("is_marginal"))
    return counted.select("w", "u", "n", F.lit(False).alias("is_marginal")).unionByName(total)


def marker_first(counted: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """``with_marginals`` in parts by word, each word's total before its neighbours, which a reader
    can then divide as they come."""
    return with_marginals(counted, total).repartition("w").sortWithinPartitions("w", F.desc("is_marginal"), "u")


def relative(counted: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """(w, u, n, f): share of ``u`` among the neighbours of ``w``. Totals of frequent words are
    broadcast, so that their many neighbours need not meet in one task. ``total``: the marginals, if they are at hand;
    a word has at most so many different neighbours."""
    if total is None:
        counted = persist_table(counted, "pairs")
        total = counted.groupBy("w").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    else:
        total = total.select("w", F.col("n").alias("total"), F.col("n").alias("rows"))
    return attach(counted, persist_table(total, "totals"), "w", "rows", ["u"]).select("w", "u", "n", (F.col("n") / F.col("total")).alias("f"))
