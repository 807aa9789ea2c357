from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pytest

from stoneloom.llm import quality as op

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string, label string"
PROSE = "The old mill by the river had not been used for years, and most of the people in the village had forgotten it. "


def corpus(n=400):
    rng = np.random.default_rng(2)
    words = (PROSE * 2).split()
    out = []
    for i in range(n):
        prose = " ".join(rng.permutation(words)[: int(rng.integers(12, 45))]) + "."
        kind = i % 8
        if kind == 0:
            prose = " | ".join(w for w in prose.split() if len(w) > 3)
        elif kind == 1:
            prose = " ".join(f"{w}%%%" for w in prose.split())
        elif kind == 2:
            prose = " ".join(f"{w}!!" for w in prose.upper().split())
        elif kind == 3:
            prose = "again " * 40
        out.append((i, prose, "en", "clash"))
    return out


def test_labels_held_out(spark):
    """No hand label is read in training, so all of them are held out."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model, _ = op.train(docs)
    found = {r["doc_id"]: r["keep"] for r in op.classify(docs, model).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good = [found[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [not found[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) > 0.9
    assert all(a > 0.6 for a in model.labels.accuracies)


def test_finds_junk_without_labels(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model, labelled = op.train(docs)
    found = {r["doc_id"]: r for r in op.classify(docs, model).collect()}
    right = np.mean([found[i]["keep"] == (i % 8 > 3) for i in found])
    assert right > 0.97 and labelled.count() == 400
    kept = op.keep_good(docs)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["keep"]}


def test_same_result_again_and_in_any_order(spark):
    rows = corpus(120)
    a, b = (
        sorted(map(tuple, op.classify(d, op.train(d)[0]).collect()))
        for d in (spark.createDataFrame(r, SCHEMA).repartition(n) for r, n in ((rows, 1), (rows[::-1], 3)))
    )
    assert a == b


def test_odd_rows_stay(spark):
    odd = [(500, None), (501, ""), (502, " \n"), (503, "One."), (None, "short text"), (505, PROSE * 5000), (505, PROSE * 5000)]
    docs = spark.createDataFrame(corpus() + [(i, t, None, None) for i, t in odd], SCHEMA)
    model, _ = op.train(docs)
    found = [r for r in op.classify(docs, model).collect() if r["doc_id"] is None or r["doc_id"] >= 500]
    assert len(found) == len(odd) and all(r["keep"] for r in found)


def test_clean_corpus_loses_nothing(spark):
    docs = spark.createDataFrame([r for r in corpus() if r[0] % 8 > 3], SCHEMA)
    assert op.keep_good(docs).count() == docs.count()


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model, labelled = op.train(docs)
    assert op.classify(docs, model).count() == labelled.count() == op.keep_good(docs).count() == 0


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(7)
    n, share = 20_000, 0.2
    junk = rng.random(n) < share
    hits = np.linspace(0.3, 0.9, len(op.LABELLERS))
    false = np.linspace(0.0, 0.018, len(op.LABELLERS))
    code = np.zeros(n, np.int64)
    for hit, alarm in zip(hits, false, strict=True):
        vote = rng.random(n) < np.where(junk, hit, alarm)
        says = rng.random(n) < 0.8
        code = 3 * code + np.where(says, np.where(vote, op.JUNK, op.FINE), op.NONE)
    patterns, counts = np.unique(code, return_counts=True)
    model = op.LabelModel.fit(patterns, counts)
    assert abs(model.junk_share - share) < 0.02
    assert np.abs(model.tables[:, 1, op.JUNK] - hits).max() < 0.04
    assert np.abs(np.array(model.accuracies) - ((1 - share) * (1 - false) + share * hits)).max() < 0.02


@pytest.mark.parametrize("word", ["a", "Ab", "ABC", "it's", "x,", "y.", "Z", "%%%", "a###", "12", "WOW!!", "é.", "Éa,", "...", "a.b.", "ﬁ", "中", "ǅa", "b,,"])
def test_fast_codes_equal_slow_ones(word):
    assert op._Codes()[word] == op._Codes.slow(word)


def plain_facts(text):
    """The labellers' facts, character by character."""
    words = text.split()
    letters = [[c for c in w if c.isalpha()] for w in words]
    lettered = [i for i, x in enumerate(letters) if x]
    n, k = len(words), max(1, len([i for i in range(len(words)) if letters[i]]))
    dressed = lambda w: any(a in "#$%&*~^=+<>@|\\_" and b in "#$%&*~^=+<>@|\\_" for a, b in zip(w, w[1:], strict=False)) or any(c in "#$%*~^|" for c in w)
    return {
        "symbols": sum(dressed(words[i]) for i in lettered) / n,
        "bare": sum(not letters[i] and not any(c.isdigit() for c in w) for i, w in enumerate(words)) / n,
        "capitals": sum(len(letters[i]) > 1 and all(c.isupper() for c in letters[i]) for i in lettered) / k,
        "shout": sum(w.endswith("!!") for w in words) / n,
        "again": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "variety": len(set(words)) / n,
        "short": sum(len(letters[i]) <= 3 for i in lettered) / k,
        "ends": sum(w[-1] in ".!?:。！？…" for w in words) / n,
        "letters": 1 - sum(not c.isalnum() for w in words for c in w) / sum(map(len, words)),
    }


def plain_votes(text):
    facts = plain_facts(text) if text.split() else {}
    out = []
    for name, junk, fine, sign, least in op.LABELLERS:
        if len(text.split()) < least:
            out.append(op.NONE)
        else:
            out.append(op.JUNK if sign * facts[name] > sign * junk else op.FINE if sign * facts[name] < sign * fine else op.NONE)
    return out


def plain_features(text):
    shapes = []
    for w in text.split():
        shape = ""
        for c in w:
            sign = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            shape += sign if shape[-1:] != sign else ""
        shapes.append(zlib.crc32(shape.encode()) % op.DIMENSIONS)
    out = [0.0] * op.DIMENSIONS
    for s in shapes:
        out[s] += 1 / len(shapes)
    for a, b in zip(shapes, shapes[1:], strict=False):
        out[(a * 619 + b * 31 + 7) % op.DIMENSIONS] += 1 / len(shapes)
    return [x**0.5 for x in out]


TEXTS = [t for _, t, *_ in corpus(80)] + ["", "One.", "WOW!! " * 9, "x" * 3000 + " " + "#" * 3_000_000, "é Ça 12 a1 ... !? — «x» ﬁn ǅa中", "a-b_c=d <e> @f f@g h&&i " * 30, "A.B.C. " * 70]


def test_votes_and_features_against_plain_versions():
    for text in TEXTS:
        words, codes = op.read_words(text)
        assert op.votes(words, codes) == plain_votes(text), text[:60]
        if len(text) < 10_000:
            assert op.features(codes) == pytest.approx(plain_features(text), abs=1e-6)


def test_shapes_are_read_whole():
    assert op.word_shape("aB1-" * 20) != op.word_shape("aB1-" * 20 + "x") and len(op.word_shape("aB" * 50)) == 100


def test_label_model_against_a_plain_version():
    """Expectation and maximisation written out, for every pattern and labeller."""
    rng = np.random.default_rng(11)
    n = len(op.LABELLERS)
    rows = sorted({tuple(int(x) for x in rng.choice(3, n, p=[0.2, 0.7, 0.1])) for _ in range(60)})
    counts = [int(c) for c in rng.integers(1, 50, len(rows))]
    p = [0.9 if op.JUNK in v else 0.02 for v in rows]
    for _ in range(25):
        share = min(max((sum(c * x for c, x in zip(counts, p, strict=True)) + 1) / (sum(counts) + 10), 1e-6), 0.49)
        table = {}
        for j in range(n):
            for y in (0, 1):
                said = {vote: sum(c * (x if y else 1 - x) for v, c, x in zip(rows, counts, p, strict=True) if v[j] == vote) for vote in (op.FINE, op.JUNK)}
                voted = sum(said.values())
                more = {op.FINE: (1 - op.FALSE_ALARMS) * op.BELIEF * voted, op.JUNK: op.FALSE_ALARMS * op.BELIEF * voted} if y == 0 else {op.FINE: 0, op.JUNK: 0}
                said = {vote: k + 1 + more[vote] for vote, k in said.items()}
                table[j, y] = {vote: k / sum(said.values()) for vote, k in said.items()}
        p = []
        for v in rows:
            like = [1 - share, share]
            for j, vote in enumerate(v):
                for y in (0, 1):
                    like[y] *= table[j, y].get(vote, 1.0)
            p.append(like[1] / sum(like))
    codes = [sum(vote * 3 ** (n - 1 - j) for j, vote in enumerate(v)) for v in rows]
    model = op.LabelModel.fit(codes, counts, rounds=25)
    assert model.junk_share == pytest.approx(share, rel=1e-3)
    assert model.posterior(np.array(codes)) == pytest.approx(p, abs=2e-3)


def test_scores_against_a_plain_version(spark):
    docs = spark.createDataFrame(corpus(200), SCHEMA)
    model, _ = op.train(docs)
    for r in op.classify(docs, model).collect():
        text = dict((i, t) for i, t, *_ in corpus(200))[r["doc_id"]] if r["doc_id"] < 3 else None
        if text is not None:
            n = len(text.split())
            odds = sum(a * float(b) for a, b in zip(plain_features(text), model.weights, strict=True)) + model.intercept
            odds = (n * odds + op.EVIDENCE * math.log(op.BLANK / (1 - op.BLANK))) / (n + op.EVIDENCE)
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=2e-4) and r["keep"] == (r["score"] < op.THRESHOLD)


def test_short_texts_are_scored(spark):
    """By their words, the less the fewer there are; a word or two of anything stay."""
    junk = "one%%% two%%% three%%% four%%% five%%% six%%% seven%%%"
    short = [(500, junk, "en", ""), (501, " ".join(junk.split()[:3]), "en", ""), (502, "Yes.", "en", ""), (503, "The mill by the river was old.", "en", ""), (504, "", "en", "")]
    docs = spark.createDataFrame(corpus() + short, SCHEMA)
    model, _ = op.train(docs)
    found = {r["doc_id"]: r for r in op.classify(docs, model).collect()}
    scores = [found[i]["score"] for i in range(500, 505)]
    assert scores[0] > scores[1] > scores[4] == pytest.approx(op.BLANK) and scores[0] > 2 * scores[3]
    assert all(found[i]["keep"] for i in range(501, 505))
