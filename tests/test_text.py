from __future__ import annotations

import os
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stoneloom import scratch
from stoneloom.functions.tokens import STOPWORDS, tokenize
from stoneloom.joins import attach
from stoneloom.operators import cooccurrence, counting, index
from stoneloom.plans import text as text_plans
from stoneloom.sources import parse_log, write_nothing

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LINE = "Hello, hello world! it's  a--b -"


def counts(spark, lines, mode, **more):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return {r["term"]: r["n"] for r in counting.term_counts(df, mode, **more).collect()}


def test_tokenisers(spark):
    assert counts(spark, [LINE], "strip_last") == {"hello": 2, "world": 1, "it'": 1, "a--": 1, "": 1}
    assert counts(spark, [LINE], "raw") == {"hello,": 1, "hello": 1, "world!": 1, "it's": 1, "a--b": 1, "-": 1}
    assert counts(spark, [LINE], "alnum") == {"hello": 2, "world": 1, "its": 1, "ab": 1}
    spaced = [f" {LINE}  ", ""]
    assert counts(spark, spaced, "single_ws") == {"": 3, "hello,": 1, "hello": 1, "world!": 1, "it's": 1, "a--b": 1, "-": 1}


@pytest.mark.parametrize("line,tokens", [("", [""]), ("   ", []), ("a", ["a"]), (" a", ["", "a"]), ("a  ", ["a"]), (None, None)])
def test_single_ws_edges(spark, line, tokens):
    df = spark.createDataFrame([(line,)], "value string").select(tokenize("value", "single_ws").alias("t"))
    assert df.first()["t"] == tokens


def test_null_lines_count_nothing(spark):
    for mode in ("strip_last", "raw", "alnum", "single_ws"):
        assert counts(spark, [None], mode) == {}


def test_partitions_change_nothing_but_partitions(spark):
    df = spark.createDataFrame([(LINE,)] * 3, "value string")
    some = counting.term_counts(df, "alnum", partitions=3)
    assert some.rdd.getNumPartitions() == 3
    assert {r["term"]: r["n"] for r in some.collect()} == {"hello": 6, "world": 3, "its": 3, "ab": 3}


def test_mean(spark, rows):
    lines = spark.createDataFrame([("a 1 b 10",), ("a 2",), ("b 5",), ("c -7",), ("c 0",), ("d x",)], "value string")
    assert rows(counting.mean_by_key(parse_log(lines))) == [("a", 1), ("b", 7), ("c", -3)]


def test_mean_at_the_ends_of_a_long(spark, rows):
    df = spark.createDataFrame([("a", -7), ("a", None), (None, 3)], "key string, v int")
    assert rows(counting.mean_by_key(df)) == [("a", -7), (None, 3)]


def test_cooccurrence(spark, rows):
    lines = spark.createDataFrame([("a b c",), ("A b",), ("solo",), (None,), ("",)], "value string")
    counted = cooccurrence.pairs(lines)
    assert rows(counted) == [("a", "b", 2), ("b", "a", 2), ("b", "c", 1), ("c", "b", 1)]
    assert rows(cooccurrence.marginals(counted)) == [("a", 2), ("b", 3), ("c", 1)]
    shares = {(r["w"], r["u"]): round(r["f"], 6) for r in cooccurrence.relative(counted).collect()}
    assert shares == {("a", "b"): 1.0, ("b", "a"): 0.666667, ("b", "c"): 0.333333, ("c", "b"): 1.0}
    total = cooccurrence.with_marginals(counted).where("is_marginal")
    assert rows(total, "w", "n") == [("a", 2), ("b", 3), ("c", 1)]
    found = {r["w"]: r["stripe"] for r in cooccurrence.stripes(lines).collect()}
    assert found == {"a": {"b": 1}, "A": {"b": 1}, "b": {"a": 2, "c": 1}, "c": {"b": 1}, "solo": {}, "": {}}


def test_stripes_in_blocks(spark, rows):
    """A block is a part of a stripe; words that stood alone and have neighbours elsewhere have no empty one."""
    lines = spark.createDataFrame([("hub",), ("solo",), *[(f"hub x{i}",) for i in range(200)]], "value string")
    found = cooccurrence.stripes(lines, block_words=20).collect()
    hub = [r["stripe"] for r in found if r["w"] == "hub"]
    assert len(hub) > 4 and all(hub) and {k for s in hub for k in s} == {f"x{i}" for i in range(200)}
    assert [(r["block"], r["stripe"]) for r in found if r["w"] == "solo"] == [(0, {})]


def test_marker_comes_first(spark):
    counted = cooccurrence.pairs(spark.createDataFrame([("a b c a",)], "value string"))
    parts = cooccurrence.marker_first(counted).rdd.glom().collect()
    got = {r["w"]: [x["is_marginal"] for p in parts for x in p if x["w"] == r["w"]] for p in parts for r in p}
    assert got == {"a": [True, False, False], "b": [True, False, False], "c": [True, False, False]}


def test_partition_is_the_rest_of_the_key(spark, rows):
    got = counting.by_residue(spark.range(-3, 20), "id", 4).select(F.spark_partition_id().alias("p"), "id")
    assert all(p == i % 4 for p, i in rows(got))


def test_joins_without_a_hot_key(spark, rows):
    df = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(3000)] + [(-1, None)], "id long, k string")
    groups = df.where("k IS NOT NULL AND k <> 'k0'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = attach(df, groups, "k", "n", ["id"])
    assert rows(got) == sorted(((i, "hot" if i % 2 else f"k{i}", 1 if i % 2 else i) for i in range(1, 3000)), key=repr)
    assert attach(df, groups, "k", "n", ["id"], "left").count() == 3001


def test_scratch(spark, tmp_path, monkeypatch):
    """No folder of this machine on a cluster; what was written is deleted when asked for."""
    monkeypatch.setattr(scratch, "_written", [])
    df = scratch.persist_table(spark.range(3), "three")
    path = df.inputFiles()[0].removeprefix("file:")
    assert df.count() == 3 and os.path.exists(path)
    scratch.release_scratch(spark)
    assert not os.path.exists(path)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://elsewhere:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch.shared_dir(cluster)


def test_index_with_one_exchange(spark, rows):
    docs = spark.createDataFrame([(i, f"term{i % 5} common other{i} common") for i in range(-3, 60)] + [(7, None)], "doc_id long, text string")
    one = index.index_documents(docs, block_docs=16)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert rows(one) == rows(index.inverted_index(index.term_frequencies(docs), block_docs=16))
    assert plan.count("Exchange hashpartitioning") == 1


def test_null_sink(spark):
    seen = spark.sparkContext.accumulator(0)
    write_nothing(spark.range(5).mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), "id long"))
    assert seen.value == 5


def test_window_is_symmetric_and_a_star_is_a_word(spark, rows):
    lines = spark.createDataFrame([("* x * y",), ("p q r s t",)], "value string")
    counted = {(w, u): n for w, u, n in rows(cooccurrence.pairs(lines, window=3))}
    assert all(counted[u, w] == n for (w, u), n in counted.items())
    assert counted["*", "*"] == 2 and ("p", "t") not in counted and counted["p", "s"] == 1


ODD = ["The the THE cat", " a  b\ta", "", "   ", "x \u2028", "É é e\u0301", "solo", "* x * y", "p q r s t", "Solo", "\x0b\x0cz"]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def plain_pairs(lines, window):
    """Words of a line by the rules of single blanks, as written, and all pairs of them."""
    split = [re.split(r"[ \t\n\x0b\f\r]", t) if (t := x.rstrip(" \t\n\x0b\f\r")) else [""] * (x == "") for x in lines]
    return split, [(w, t[j].lower()) for t in split for i, w in enumerate(t) for j in range(len(t)) if 0 < abs(i - j) <= window]


@pytest.mark.parametrize("window", [1, 2, 4])
def test_pairs_are_counted_in_one_order(spark, rows, window):
    """Against brute force; the exchange gets one text for two words, made by compiled expressions."""
    lines = spark.createDataFrame([(x,) for x in [*ODD, None]], "value string")
    got = cooccurrence.pairs(lines, window=window)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and len(re.findall(r"Exchange hashpartitioning\(\w+#\d+, \d+\)", plan)) == 1
    want = Counter((w.lower(), u) for w, u in plain_pairs(ODD, window)[1])
    assert rows(got) == sorted(((w, u, n) for (w, u), n in want.items()), key=repr)


@pytest.mark.parametrize("window", [1, 2])
def test_stripes_of_words_as_written(spark, monkeypatch, window):
    """Against brute force: pairs are counted in one order, as written; stripes are gathered by tasks as many as they need."""
    monkeypatch.setattr(cooccurrence, "TASK_PAIRS", 8)
    lines = spark.createDataFrame([(x,) for x in [*ODD, None]], "value string")
    df = cooccurrence.stripes(lines, window=window, block_words=4)
    assert df.rdd.getNumPartitions() > 4
    split, found = plain_pairs(ODD, window)
    got = [(r["w"], u, n) for r in df.collect() for u, n in (r["stripe"] or {None: 0}).items()]
    alone = {t[0] for t in split if len(t) == 1} - {w for w, _ in found}
    assert sorted(got, key=repr) == sorted([*((w, u, n) for (w, u), n in Counter(found).items()), *((w, None, 0) for w in alone)], key=repr)


@pytest.mark.parametrize("window", [1, 2, 4])
def test_totals_need_no_pairs(spark, rows, window):
    lines = spark.createDataFrame([(x,) for x in [*ODD, None]], "value string")
    assert rows(cooccurrence.totals(lines, window=window)) == rows(cooccurrence.marginals(cooccurrence.pairs(lines, window=window)))
    assert exchanges(text_plans.cooc_marginals(spark, DATA)) == 1


def test_totals_at_hand_are_taken(spark, rows):
    lines = spark.createDataFrame([(x,) for x in ODD], "value string")
    counted = cooccurrence.pairs(lines)
    assert rows(cooccurrence.with_marginals(counted, cooccurrence.totals(lines))) == rows(cooccurrence.with_marginals(counted))
    assert exchanges(text_plans.cooc_absolute(spark, DATA)) == 2


def test_marker_first_with_totals_at_hand(spark, rows):
    lines = spark.createDataFrame([(x,) for x in ODD], "value string")
    counted = cooccurrence.pairs(lines)
    assert rows(cooccurrence.marker_first(counted, cooccurrence.totals(lines))) == rows(cooccurrence.marker_first(counted))
    assert exchanges(text_plans.cooc_marker_first(spark, DATA)) == 3


def test_shares_write_no_pairs(spark, rows, monkeypatch):
    lines = spark.createDataFrame([(x,) for x in ODD], "value string")
    counted = cooccurrence.pairs(lines)
    assert rows(cooccurrence.relative(counted, cooccurrence.totals(lines))) == rows(cooccurrence.relative(counted))
    monkeypatch.setattr(scratch, "_written", written := [])
    text_plans.cooc_relative(spark, DATA)
    assert [re.sub("-.*", "", os.path.basename(x)) for x in written] == ["totals"]
    scratch.release_scratch(spark)


def test_documents_are_dealt_whole(spark, rows, monkeypatch):
    """Texts pass the exchange, and words are counted where they are; an id with too much text is counted by its words."""
    docs = spark.createDataFrame([(i % 40 or None, f"t{i % 5} the one one") for i in range(60)], "doc_id long, text string")
    want = Counter((t, i % 40 or None) for i in range(60) for t in (f"t{i % 5}", "one", "one"))
    want = sorted(((t, i, n) for (t, i), n in want.items()), key=repr)
    assert "hashpartitioning(doc_id" in index.term_frequencies(docs)._jdf.queryExecution().executedPlan().toString()
    assert exchanges(index.term_frequencies(docs)) == exchanges(index.line_frequencies(docs)) == 1
    assert rows(index.term_frequencies(docs)) == want
    monkeypatch.setattr(index, "PART_BYTES", 20)
    assert "hashpartitioning(term" in index.term_frequencies(docs)._jdf.queryExecution().executedPlan().toString()
    assert rows(index.term_frequencies(docs)) == want


def test_tasks_of_the_index_grow_with_the_texts(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(i, "some words " * 10) for i in range(20)], "doc_id long, text string")
    want = rows(index.index_documents(docs))
    monkeypatch.setattr(index, "PART_BYTES", 100)
    assert re.search(r"hashpartitioning\(term#\d+, block#\d+L?, 22\)", index.index_documents(docs)._jdf.queryExecution().executedPlan().toString())
    assert rows(index.index_documents(docs)) == want


def test_inverted_index(spark, rows):
    docs = spark.createDataFrame([(1, "The cat sat. The cat!"), (2, "Cat it's were-wolf"), (10, "sat"), (11, None)], "doc_id long, text string")
    tf = index.term_frequencies(docs)
    found = {r["term"]: [tuple(p) for p in r["postings"]] for r in index.inverted_index(tf).collect()}
    assert found == {"cat": [(1, 2), (2, 1)], "sat": [(1, 1), (10, 1)], "werewolf": [(2, 1)]}
    blocks = index.inverted_index(tf, block_docs=2)
    assert rows(blocks.where("term = 'cat'"), "block", "df") == [(0, 1), (1, 1)]
    assert rows(index.lookup(blocks, "cat")) == [(1, 2), (2, 1)]
    assert rows(index.document_frequencies(tf)) == [("cat", 2), ("sat", 2), ("werewolf", 1)]
    assert rows(index.line_frequencies(docs.limit(1)))[:2] == [("cat!", 1, 1), ("cat", 1, 1)]


def test_stop_words():
    assert len(STOPWORDS) == 174 and {"the", "its", "isn't"} <= STOPWORDS


def test_no_python_in_plans(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = index.inverted_index(index.term_frequencies(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
