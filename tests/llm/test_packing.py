from __future__ import annotations

import zlib

import numpy as np
import pytest

from stoneloom.llm import packing as op

SCHEMA = "doc_id long, text string, start string"
tokenizers = pytest.importorskip("tokenizers")


def brute_ids(texts):
    t = tokenizers.Tokenizer.from_file(op.default_vocabulary())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]


def check(pieces, docs, window=op.WINDOW):
    """Every id in one piece, sequences gapless; the share of padding."""
    want = dict(zip([i for i, _ in docs], brute_ids([t for _, t in docs]), strict=True))
    at = dict.fromkeys(want, 0)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = want[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(ids)
        part = ids[p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] > 0 and p["ids_crc32"] == zlib.crc32(part.tobytes())
        at[p["doc_id"]] += p["length"]
    assert all(at[i] == len(want[i]) for i in want)
    fill: dict[int, int] = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0)
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= window for n in fill.values())
    return 1 - sum(fill.values()) / (window * max(1, len(fill)))


def run(spark, docs, partitions=1, **more):
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA).repartition(partitions)
    return op.digests(op.pack(df, **more)).collect()


def test_round_trip_and_padding(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{rng.integers(500)}" for _ in range(rng.integers(0, 900)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "<|endoftext|> é 中文 \x00 don't" * 3), (1003, "x" * 400_000), (1004, "y z " * 100_000)]
    assert check(run(spark, docs), docs) < 0.01
    assert check(run(spark, docs, 5), docs) < 0.02
    assert check(run(spark, docs, window=64), docs, 64) < 0.01


def test_few(spark):
    assert run(spark, []) == []
    (one,) = run(spark, [(7, None)])
    assert (one["length"], one["doc_tokens"], one["offset"], one["start"]) == (1, 1, 0, 0)
    twice = run(spark, [(7, "a"), (7, "a")])
    assert sorted(p["length"] for p in twice) == [2, 2] and {p["doc_tokens"] for p in twice} == {2}


def test_long_blanks(spark):
    docs = [(1, " " * 300_000 + "a"), (2, "\n" * 1_000_000)]
    check(run(spark, docs), docs)


def squares(counts):
    return sum(n * n for n in counts)


def overhang(pieces, row, size):
    """What of the document is not in the window."""
    return size - sum(len(p[2]) for p in pieces if p[0] == row)


@pytest.mark.parametrize("window,granule", [(32, 1), (1024, 64), (100, 30)])
def test_places_minimise_the_sum_of_squares(window, granule):
    """Against trying every place: levels, and the extra for a long cut."""
    rng = np.random.default_rng(4)
    levels = op.Levels(window, granule)
    for i in range(3000):
        size = int(rng.integers(1, window))
        before = levels.counts.copy()
        options = []
        for c in [-1, *range(len(before))]:
            fill = levels.open[c][-1][0] if c >= 0 and levels.open[c] else 0
            if c >= 0 and not fill:
                continue
            after = before.copy()
            if c >= 0:
                after[c] -= 1
            if fill + size < window:
                after[(fill + size) // granule] += 1
            options.append((squares(after) + (op.CUT if fill + size - window >= granule else 0), max(0, fill + size - window)))
        full = list(levels.place((i, 0, np.zeros(size, np.uint32))))
        assert all(sum(len(p[2]) for p in w) == window for w in full)
        least = min(options)[0]
        if not full or len(full) == 1 and not overhang(full[0], i, size):
            assert squares(levels.counts) == least
        assert levels.counts == [len(x) for x in levels.open]
        assert all(f // granule == c and f == sum(len(p[2]) for p in pieces) for c, x in enumerate(levels.open) for f, pieces in x)
    rest = list(levels.finish())
    assert all(sum(len(p[2]) for p in w) == window for w in rest[:-1]) and levels.n_open == 0


def test_open_windows_are_bounded():
    """Also where no two pieces fit into one window."""
    rng = np.random.default_rng(5)
    for low, high in ((513, 620), (1, 1024), (500, 524), (1000, 1024), (1, 3)):
        levels = op.Levels(1024)
        for i in range(5000):
            for _ in levels.place((i, 0, np.zeros(int(rng.integers(low, high)), np.uint8))):
                pass
            assert levels.n_open < 16 * op.CUT


def test_placement_fills_the_windows(spark):
    """Over a table: most windows that are not cut off whole are filled by placement, few at the end, and padding is small."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    levels, placed = op.Levels(op.WINDOW), 0
    for i, t in enumerate(texts):
        n = (len(op.token_ids(t or "", op.default_vocabulary())) + 1) % op.WINDOW
        placed += len(list(levels.place((i, 0, np.zeros(n, np.uint8))))) if n else 0
    at_end = list(levels.finish())
    assert placed > 20 * len(at_end) and sum(len(p[2]) for w in at_end for p in w) > op.WINDOW * (len(at_end) - 1)


def test_null_ids_and_small_batches(spark):
    docs = [(i, "word " * (i % 37)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    schema = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    pieces = df.mapInArrow(op.packer(op.default_vocabulary(), 64, flush_bytes=64), schema)
    check(op.digests(pieces).collect(), docs, 64)
    null = op.digests(op.pack(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string").coalesce(1))).collect()
    assert sorted(p["doc_tokens"] for p in null) == [1, 3] and {p["doc_id"] for p in null} == {None}
