from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

PROSE = "The old mill by the river had not been used for years and most of the people in the village had forgotten it by the time the new road came".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    good = [(i, " ".join(PROSE[i % 9 :] + [f"number {i} of many such"] + PROSE[: 3 + i % 20] + [f"and {i} more things of that kind happened here."])) for i in range(60)]
    docs = [*good, (100, good[3][1].replace(" ", "  ")), (101, good[3][1] + " End"), (102, " | ".join(["Words", "apart"] * 20)), (103, "junk%%% " * 60), (104, None), (105, None)]
    return [(i, t, "en", "src0", len(t or "")) for i, t in docs]


def test_stages_work_on_what_is_left(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], str(tmp_path))
        assert out.columns == docs.columns, name
        seen.append(out)
    ids = [{r["doc_id"] for r in d.collect()} for d in seen]
    assert {102, 103} & ids[0] and not {102, 103} & ids[1] and ids[0] - ids[1] == {102, 103}
    assert ids[1] - ids[2] == {100, 105}
    assert 101 in ids[2] and 101 not in ids[3] and 3 in ids[3]


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, again.collect()))
    left = {r["doc_id"] for r in pieces.collect()}
    assert not left & {100, 101, 102, 103, 105} and 104 in left and 3 in left
    assert re.sub("_", "", "".join(n for n, _ in corpus_pipeline.STAGES)) == "qualityexactdedupneardeduppacking"


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_not_ids_are_dropped(spark, tmp_path):
    """A copy goes with its row only: not with other rows of its id, and one row stays where ids are equal or missing."""
    rows = [(1, "same text"), (1, "same text"), (3, "alpha"), (7, "alpha"), (7, "beta only here"), (None, "gamma"), (None, "gamma")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted({(1, "same text"), (3, "alpha"), (7, "beta only here"), (None, "gamma")}, key=repr)
    kept = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted({(1, "same text"), (3, "alpha"), (7, "beta only here"), (None, "gamma")}, key=repr)


def test_against_a_brute_force_pipeline(spark, tmp_path):
    """The stages after the classifier, with repeated rows and ids, null ids and columns of clashing names."""
    rng = np.random.default_rng(4)
    docs = []
    for i in range(90):
        words = [f"w{x}" for x in rng.integers(0, 500, 40)] if i % 3 or not docs else (docs[int(rng.integers(len(docs)))][1] or "one two").split()
        if i % 6 == 3:
            words[int(rng.integers(len(words)))] = f"new{i}"
        docs.append((None if i % 17 == 5 else int(i % 60), (" " if i % 3 else "  ").join(words) if i % 13 else None, i))
    frame = spark.createDataFrame(docs, "doc_id long, text string, row int").withColumn("t", F.lit("clash"))
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    exact: dict = {}
    for d in order:
        exact.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d[1] or ""), d)
    one = corpus_pipeline.exact(spark, frame, str(tmp_path))
    assert one.columns == frame.columns
    same = lambda d: (d[0], " ".join((d[1] or "").split()))  # noqa: E731  any of rows equal in both may stay
    assert sorted(map(repr, map(same, one.collect()))) == sorted(map(repr, map(same, exact.values())))

    left = sorted(exact.values(), key=lambda d: (d[0] is None, d[0] or 0))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((d[1] or "").split() for d in left)]
    root = list(range(len(left)))
    for _ in left:
        for a in range(len(left)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    want = [d for i, d in enumerate(left) if root[i] == i]
    two = corpus_pipeline.near(spark, one, str(tmp_path))
    assert two.columns == frame.columns and len(want) < len(left)
    assert sorted(map(repr, map(same, two.collect()))) == sorted(map(repr, map(same, want)))
