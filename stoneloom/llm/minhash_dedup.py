"""Near-duplicate detection by b-bit MinHash.

1. Every text becomes the set of its five-word shingles (64-bit hashes), of which it keeps the
   size, a digest of the whole set, ``BANDS`` band keys of ``ROWS`` minima each and the low
   ``BITS`` bits of all minima, packed. Documents whose sets are equal form a class; only its
   smallest id goes on, so copies, however many, are one node.
2. Candidates: within a band's bucket each member is tied to the bucket's smallest id, its leader.
   A document follows the smallest of its leaders, and its other leaders are tied to that one; the
   components of these ties between leaders are clusters that no bucket crosses: every pair that
   shares a bucket is inside one.
3. Links: each cluster is searched in one task, a tile, of at most ``TILE_DOCS`` documents and
   ``TILE_SHINGLES`` shingles. In a tile the packed signatures give a collision-corrected
   estimate for all pairs of different components by bit counts; pairs whose estimate is within
   six standard errors of the threshold are confirmed on the full sets, the most similar first,
   and joined. Pairs already connected are not confirmed again: the components are the same.
   A tile returns a spanning forest of its links.
   A larger cluster is dealt into chunks, and each is searched alone; then the smallest ids of
   the chunks' components are searched. That leaves one component of a group of near copies, and
   nothing more to do. Of a cluster that still has several, the largest component is dealt into
   chunks of its own, and tiles of two chunks cover all pairs that are not inside it. So memory is
   bounded and no pair is missed; work is the largest component's size times the rest's.
4. Components of the links give every class, and so every document, its component.

A pair at similarity 0.85 is no candidate with probability 7e-9, at 0.8 with 3e-6. 64-bit shingle hashes
make two different shingles of a pair equal with a probability below 1e-11.

Defined results: texts without words (null or blank) have no shingles and link with nothing;
texts with fewer than five words have one shingle, all of it; rows with the same id and text
count as one document; a row with a null id has no component unless its set has an id; other
columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import persist_table
from ..session import ship_package
from .common import attach_groups, connected_components, followed, small_side, table

WORDS = 5
BANDS, ROWS, BITS = 32, 5, 4
PERMUTATIONS = BANDS * ROWS
TILE_DOCS, TILE_SHINGLES = 1024, 1 << 22
#: Hashes of words that a Python worker remembers.
WORD_HASHES = 1 << 17

_rng = np.random.Generator(np.random.PCG64(20240601))
_MULTIPLY = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_PLACE = _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _rng.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    # on bytes, lower() and split() know A-Z and the contract's white space only
    words = (text or "").encode().lower().split()
    if len(_words) > WORD_HASHES:
        _words.clear()
    n = len(words)
    if not n:
        return np.array([], np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    s = h[: n - WORDS + 1] * _PLACE[0]
    for i in range(1, WORDS):
        s += h[i : n - WORDS + 1 + i] * _PLACE[i]
    return np.unique(_mixed(s))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        block = np.bitwise_xor.outer(_XOR, x[at : at + 512])
        block *= _MULTIPLY[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    return _mixed((m.reshape(BANDS, ROWS).astype(np.uint64) * _KEY).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def packed(m: np.ndarray) -> bytes:
    """Low four bits of each minimum, two in a byte."""
    low = (m & np.uint32(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << np.uint8(4))).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                n, digests, keys, bits = [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    s = shingles(text.as_py())
                    n.append(len(s))
                    if len(s):
                        m = minima(s)
                        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        keys.append(band_keys(m))
                        bits.append(packed(m))
                    else:  # equal to no other
                        digests.append(b"empty %d" % key if key is not None else None)
                        keys.append(None)
                        bits.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "bands", "bits"],
                )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, bands array<long>, bits binary")


class _Forest:
    """Components of a tile. Members are in order of their ids, so a root has the smallest."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members = [[i] for i in range(n)]

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root[a], self.root[b]))
        if a != b:
            self.root[self.members[b]] = a
            self.members[a] += self.members[b]
            self.members[b] = []


def mismatches(bits: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing b-bit values between rows of 64-bit words and one row."""
    x = bits ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def estimate(differ: np.ndarray) -> np.ndarray:
    """Similarity corrected for values that agree by chance."""
    chance = 2.0**-BITS
    return (1 - differ / PERMUTATIONS - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def search_tile(bits: np.ndarray, sizes: np.ndarray, texts: list[str], known: list[int], percent: int) -> np.ndarray:
    """Root of each member under the confirmed links. ``sizes``: shingles of each member; members
    that agree in ``known`` are connected already."""
    n = len(texts)
    forest = _Forest(n)
    first: dict[int, int] = {}
    for i, part in enumerate(known):
        forest.join(first.setdefault(part, i), i)
    sets: dict[int, np.ndarray] = {}

    def shingles_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(texts[i])
        return sets[i]

    leaders: list[int] = []  # roots of components of more than one member
    p = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    least = percent / 100 - 6 * math.sqrt(p * (1 - p) / PERMUTATIONS) / (1 - 2.0**-BITS)
    with np.errstate(over="ignore"):
        for i in range(n):

            def confirm(others: np.ndarray, i: int = i) -> None:
                likely = estimate(mismatches(bits[others], bits[i]))
                fit = (likely >= least) & (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))
                for j in others[fit][np.argsort(-likely[fit], kind="stable")]:
                    if forest.root[i] != forest.root[j] and linked(shingles_of(i), shingles_of(int(j)), percent):
                        forest.join(i, j)

            if leaders:  # most members of a large component need no more than this
                confirm(np.array(leaders))
            rest = np.flatnonzero(forest.root[:i] != forest.root[i])
            if len(rest):
                confirm(rest)
            if forest.root[i] != i or len(forest.members[i]) > 1:
                leaders = sorted({int(forest.root[x]) for x in [*leaders, i]})[:64]
    return forest.root


def _tile(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        ids = rows["doc_id"].to_numpy()
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
        root = search_tile(bits, rows["n_shingles"].to_numpy(), rows["text"].to_pylist(), rows["known"].to_pylist(), percent)
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"u": pa.array(ids[far], pa.int64()), "v": pa.array(ids[root[far]], pa.int64())})

    return run


def _chunks(docs: Column, shingles: Column, share: float = 1.0) -> Column:
    """Chunks that hold ``share`` of a tile each, in expectation."""
    return F.ceil(F.greatest(docs / (share * TILE_DOCS), shingles / (share * TILE_SHINGLES))).cast("int")


def _part(seed: int, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), chunks).cast("int")


def _search(held: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) found in the tiles (cluster, a, b); v is the smallest id of u's component in its tile."""
    rows = held.select("cluster", "a", "b", "doc_id", "n_shingles", "bits", "known", "text")
    return persist_table(rows.groupBy("cluster", "a", "b").applyInArrow(_tile(percent), "u long, v long"), "minhash-links")


def _across(texts: DataFrame, nodes: DataFrame, n_large: int, links: DataFrame, percent: int) -> DataFrame:
    """Completes ``links``, found inside the chunks of large clusters; ``nodes`` are these clusters' members."""
    texts = texts.join(small_side(nodes.select("doc_id").distinct(), nodes.count()), "doc_id", "left_semi")
    leaders = nodes.join(links.select(F.col("u").alias("doc_id")).distinct(), "doc_id", "left_anti")
    chunks = leaders.groupBy("cluster").agg(_chunks(F.count(F.lit(1)), F.sum("n_shingles")).alias("chunks"))
    leaders = leaders.join(small_side(chunks, n_large), "cluster").withColumn("a", _part(2, F.col("chunks")))
    leaders = leaders.withColumns({"b": F.col("a"), "known": F.col("doc_id")})
    links = links.union(_search(texts.join(leaders, "doc_id"), percent))

    parts = connected_components(links, "minhash-parts").select(F.col("node").alias("doc_id"), F.col("root").alias("known"))
    nodes = persist_table(nodes.join(parts, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id")), "minhash-parts")
    size = F.struct(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"), F.first("known").alias("known"))
    of = nodes.groupBy("cluster", F.col("known").alias("part")).agg(size.alias("size")).groupBy("cluster")
    of = of.agg(F.max("size").alias("main"), F.sum("size.docs").alias("docs"), F.sum("size.shingles").alias("shingles"), F.count(F.lit(1)).alias("parts"))
    rest = _chunks(F.col("docs") - F.col("main.docs"), F.col("shingles") - F.col("main.shingles"), 0.5)
    several = of.where("parts > 1").select(
        "cluster", F.col("main.known").alias("main"), _chunks(F.col("main.docs"), F.col("main.shingles"), 0.5).alias("m"), rest.alias("r")
    )
    several = persist_table(several, "minhash-several")
    n_several = several.count()
    if n_several:
        inside = F.col("known") == F.col("main")
        chunk = F.when(inside, _part(3, F.col("m"))).otherwise(F.col("m") + _part(3, F.col("r")))
        # chunks of the largest component come first, and meet only others
        others = F.sequence(F.when(inside, F.col("m")).otherwise(0), F.col("m") + F.col("r") - 1)
        pairs = F.transform(
            F.filter(others, lambda o: o != F.col("chunk")),
            lambda o: F.struct(F.least(o, "chunk").alias("a"), F.greatest(o, "chunk").alias("b")),
        )
        tiles = nodes.join(small_side(several, n_several), "cluster").withColumn("chunk", chunk)
        tiles = tiles.select("cluster", "doc_id", "n_shingles", "bits", "known", F.inline(pairs))
        links = links.union(_search(texts.join(tiles, "doc_id"), percent))
    return connected_components(links, "minhash-links").select(F.col("node").alias("u"), F.col("root").alias("v"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``. Documents are linked if
    100 * intersection >= percent * union."""
    ship_package(docs.sparkSession)
    signed = persist_table(signatures(docs, id_col, text_col), "minhash")
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = persist_table(classes, "minhash-classes")
    reps = signed.where("bands IS NOT NULL").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    reps = persist_table(reps.select("doc_id", "n_shingles", "bands", "bits"), "minhash-reps")

    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = persist_table(buckets, "minhash-buckets")
    tied = attach_groups(rows, buckets, "key", "n", "doc_id").where("group IS NOT NULL")
    tied = tied.groupBy("doc_id").agg(F.collect_set("group.first").alias("leaders"))  # at most one a band
    tied = persist_table(tied.withColumn("cluster", F.array_min("leaders")), "minhash-ties")
    ties = tied.select(F.explode("leaders").alias("u"), F.col("cluster").alias("v"))
    roots = connected_components(ties, "minhash-clusters")
    clusters = persist_table(followed(tied.select("doc_id", "cluster"), "cluster", roots, "doc_id"), "minhash-clusters")

    n_nodes = clusters.count()
    nodes = reps.select("doc_id", "n_shingles", "bits").join(small_side(clusters, n_nodes), "doc_id")
    nodes = persist_table(nodes, "minhash-nodes")
    large = nodes.groupBy("cluster").agg(_chunks(F.count(F.lit(1)), F.sum("n_shingles")).alias("chunks")).where("chunks > 1")
    n_large = large.count()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    alone = nodes.withColumn("known", F.col("doc_id"))
    if n_large:
        alone = alone.join(small_side(large, n_large), "cluster", "left").withColumn("a", _part(1, F.coalesce("chunks", F.lit(1))))
    else:
        alone = alone.withColumn("a", F.lit(0))
    links = _search(texts.join(small_side(alone.withColumn("b", F.col("a")), 2 * n_nodes), "doc_id"), percent)
    if n_large:
        links = _across(texts, persist_table(nodes.join(small_side(large.select("cluster"), n_large), "cluster"), "minhash-large"), n_large, links, percent)
    roots = links.groupBy("u").agg(F.min("v").alias("root"))
    found = classes.join(roots, F.col("rep") == F.col("u"), "left").select(
        "digest", "size", F.coalesce("root", "rep").alias("component_id")
    )
    out = attach_groups(signed.select("doc_id", "n_shingles", "digest"), found, "digest", "size", "doc_id")
    component = F.coalesce("group.component_id", "doc_id")
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"),
    )


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {"op10_minhash_dedup": op10_minhash_dedup}
ORACLES = {
    "op10_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  END AS s
  FROM w
), classes AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, s, min(doc_id) OVER (PARTITION BY CASE WHEN len(s) > 0 THEN list_sort(s) END, CASE WHEN len(s) = 0 THEN doc_id END) AS rep
  FROM s
), x AS MATERIALIZED (
  SELECT doc_id, n, unnest(s) AS shingle FROM classes WHERE doc_id = rep
), links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT DISTINCT u AS node, u AS seen FROM links
  UNION
  SELECT reach.node, links.v FROM reach JOIN links ON links.u = reach.seen
), roots AS (
  SELECT node, min(seen) AS root FROM reach GROUP BY node
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(root, rep) AS component_id, coalesce(root, rep) = doc_id AS kept
FROM classes LEFT JOIN roots ON node = rep
"""
}
