from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stoneloom.llm import topk_search as op

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(data, k, modulo):
    vs = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v) and i is not None]
    out = []
    for q in sorted({(i, tuple(v)) for i, v in vs if i % modulo == 0}):
        scored = sorted((-sum(a * b for a, b in zip(q[1], v, strict=True)), i) for i, v in vs if i != q[0] and len(v) == len(q[1]))
        out += [(q[0], r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def run(spark, data, k=5, modulo=50, **more):
    df = spark.createDataFrame([(i, v, "clash") for i, v in data], SCHEMA)
    return sorted((tuple(r) for r in op.top_k(df, F.col("vec_id") % modulo == 0, k, **more).collect()), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(300)]
    data += [(300 + i, data[0][1]) for i in range(120)]  # a hot vector: ties to the smaller id
    assert run(spark, data) == brute(data, 5, 50)
    # many tiles and a merge tree of more than one level
    assert run(spark, data, shard_rows=5, block_rows=2) == brute(data, 5, 50)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-1.0, 0.001]), (6, [1.0]), (50, [0.0, 0.0]), (None, [1.0, 1.0]), (100, [])]
    assert run(spark, data) == brute(data, 5, 50)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (2, [1.0]), (2, [1.0])]) == [(0, 1, 2, 65536), (0, 2, 2, 65536)]
    assert run(spark, [(0, [1.0]), (0, [1.0]), (2, [1.0])]) == [(0, 1, 2, 65536)]


@pytest.mark.parametrize("scale", [1, 1 << 22, 1 << 30, 1 << 40])
def test_products_are_exact(scale):
    rng = np.random.default_rng(1)
    q, c = (rng.integers(-1000, 1000, (n, 6)) * scale for n in (3, 4))
    want = [[max(-op.LIMIT, min(op.LIMIT, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in c] for x in q]
    assert op.products(q, c).tolist() == want


def test_longs_without_overflow(spark):
    huge = [(0, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [-3e38, 0.5])]
    got = run(spark, huge)
    assert [r[2] for r in got] == [1, 2] and got[0][3] > 0 > got[1][3]
