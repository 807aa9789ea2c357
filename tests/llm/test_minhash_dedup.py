from __future__ import annotations

import numpy as np
import pytest

from stoneloom.llm import common
from stoneloom.llm import minhash_dedup as op

SCHEMA = "doc_id long, text string, digest string"


def shingles(t):
    w = (t or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, percent):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def run(spark, docs, percent=85):
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA)
    return sorted(map(tuple, op.near_duplicates(df, percent).collect()))


def corpus(n=160, seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(4000)}"
    docs = []
    for i in range(n):
        if i % 4 and docs:
            words = docs[int(rng.integers(len(docs)))].split()
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = word()
            docs.append(" ".join(words))
        else:
            docs.append(" ".join(word() for _ in range(int(rng.integers(5, 250)))))
    return [(i * 3, d) for i, d in enumerate(docs)]


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    docs = corpus()
    assert run(spark, docs, percent) == brute(docs, percent)


def test_a_hub_joins_copies_that_are_no_links_themselves(spark):
    """Every copy is linked to the hub only, which has the largest id."""
    rng = np.random.default_rng(1)
    hub = [f"h{i}" for i in range(300)]
    docs = []
    for i in range(40):
        words = hub[:]
        for at in rng.choice(300, 4, replace=False):
            words[at] = f"x{i}-{at}"
        docs.append((i, " ".join(words)))
    docs.append((1000, " ".join(hub)))
    want = brute(docs, 85)
    assert sum(c == 0 for _, _, c, _ in want) > 30
    assert brute(docs[:-1], 85) != want[:-1]
    assert run(spark, docs) == want


def test_split_clusters_give_the_same(spark, monkeypatch):
    docs = corpus(120, 5) + [(10_000 + i, "same words " * 30 + f"tail{i}") for i in range(60)]
    want = brute(docs, 85)
    monkeypatch.setattr(op, "TILE_DOCS", 10)
    assert run(spark, docs) == want
    monkeypatch.setattr(op, "TILE_DOCS", 10_000)
    monkeypatch.setattr(op, "TILE_SHINGLES", 500)
    assert run(spark, docs) == want


def test_members_of_a_split_cluster_that_no_leader_links(spark, monkeypatch):
    """A chain, each text linked to the next ones only, in one cluster of many chunks."""
    words = [f"w{i}" for i in range(400)]
    docs = [(int(i), " ".join(words[at : at + 200])) for at, i in enumerate(np.random.default_rng(2).permutation(100))]
    docs += [(1000 + i, " ".join(words[:150] + [f"x{i}-{j}" for j in range(50)])) for i in range(12)]
    want = brute(docs, 85)
    assert len({c for _, _, c, _ in want}) > 1
    monkeypatch.setattr(op, "TILE_DOCS", 16)
    assert run(spark, docs) == want


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = corpus(80, 6)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert run(spark, docs) == brute(docs, 85)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "É a b c d"), (8, "é a b c d"), (9, "long word " * 60_000), (10, "LONG word " * 60_000)]
    assert run(spark, docs) == brute(docs, 85)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g"
    got = op.near_duplicates(spark.createDataFrame([(2, text, ""), (2, text, ""), (None, text, ""), (None, None, "")], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(2, 3, 2, True), (2, 3, 2, True), (None, 3, 2, False), (None, 0, None, False)], key=repr)


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.0, 0.5, 0.9):
        both = rng.integers(0, 1 << 63, 4000, np.uint64)
        own = [np.concatenate([both[: int(4000 * share)], rng.integers(0, 1 << 63, 4000 - int(4000 * share), np.uint64)]) for _ in range(2)]
        true = len(np.intersect1d(*own)) / len(np.union1d(*own))
        bits = [np.frombuffer(op.packed(op.minima(np.unique(x))), np.uint64) for x in own]
        errors.append(abs(op.estimate(op.mismatches(bits[0][None, :], bits[1]))[0] - true))
    assert max(errors) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(1, 7), (7, 3), (900, 3), (5, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in common.connected_components(df).collect()}
    assert got == {i: 100 for i in range(100, 165)} | dict.fromkeys((1, 3, 7, 900), 1)


def test_groups_attach_without_a_hot_key(spark):
    rows = spark.createDataFrame([(i, b"hot" if i % 2 else b"k%d" % i) for i in range(3000)] + [(None, None)], "id long, k binary")
    groups = rows.where("k IS NOT NULL").groupBy("k").count()
    out = common.attach_groups(rows, groups, "k", "count", "id")
    assert out.where("group.count = 1500").count() == 1500 and out.where("group.count = 1").count() == 1500
    assert out.where("group IS NULL").count() == 1


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("rows", [1 << 18, 0])
def test_components_of_a_hub_a_chain_and_a_random_graph(spark, monkeypatch, rows):
    """Also where nothing is broadcast, and where the drawn orders are needed."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(7)
    edges = [(5_000, int(i)) for i in rng.choice(4_000, 600, replace=False)]  # a hub with the largest id
    edges += [(10_000 + i, 10_001 + i) for i in range(120)]
    edges += [(int(a), int(b)) for a, b in rng.integers(20_000, 20_300, (200, 2)) if a != b]
    got = common.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["root"] for r in got.collect()} == union_find(edges)
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_large_group_of_near_copies(spark):
    """5000 different near copies of one text, in chunks of the production size, are one group."""
    base = [f"w{i}" for i in range(100)]
    docs = [(7, " ".join(base))]
    for i in range(5_000):
        words = base[:]
        words[i % 100] = f"x{i}"
        docs.append((8 + i, " ".join(words)))
    got = run(spark, docs)
    assert [(i, c) for i, _, c, _ in got] == [(i, 7) for i, _ in docs]
    assert sum(kept for *_, kept in got) == 1
