from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stoneloom.llm import gru_lm as op

SCHEMA = "doc_id long, text string, score string"


def tokens(t):
    return (t or "").encode().lower().split() + [b""]


def brute(docs):
    counts = Counter(w for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        held = i is None or zlib.crc32(str(i).encode()) % 10 == 0
        out.append((i, held, len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)))
    return sorted(out, key=repr)


def run(spark, docs):
    return op.score(spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA)).collect()


def digest(found):
    return sorted(((*list(r)[:5], round(r["base_score"], 6)) for r in found), key=repr)


def chain(n, seed=0):
    """Texts in which each word all but tells the next."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        at, text = int(rng.integers(30)), []
        for _ in range(int(rng.integers(20, 120))):
            text.append(words[at])
            at = (at * 7 + 3) % 30 if rng.random() < 0.95 else int(rng.integers(30))
        out.append((i, " ".join(text)))
    return out


def test_counts_and_base(spark, monkeypatch):
    docs = [(i, f"The the  Word{i % 7}\trare{i} É é") for i in range(60)] + [(100, None), (101, "x " * 5000), (None, "the end"), (3, "twice"), (3, "twice")]
    assert digest(run(spark, docs)) == brute(docs)
    monkeypatch.setattr(op, "KNOWN", 3)  # most words are now looked up by the join
    few = run(spark, docs)
    assert digest(few) == brute(docs)


def test_learns_held_out_texts(spark):
    docs = chain(1500)
    found = [r for r in run(spark, docs) if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in found)
    assert len(found) > 100 and found[0]["train_tokens"] > 0
    gain = (sum(r["score"] for r in found) - sum(r["base_score"] for r in found)) / tokens
    assert gain > 0.1


def test_probabilities_add_up():
    words = [f"w{i}".encode() for i in range(1500)]
    counts = np.arange(1500, 0, -1)
    mass = np.full(op._OTHER, 0.1)
    for w, c in zip(words[op.MODEL_WORDS :], counts[op.MODEL_WORDS :], strict=True):
        mass[op.other_class(w)] += c + 0.1
    v = op.Vocabulary(words, counts, mass, int(counts.sum()), 1500)
    model = op.Model.initial(v)
    h = np.random.default_rng(0).normal(0, 1, (1, op.HIDDEN)).astype(np.float32)
    total = 0.0
    for kind in range(op.CLASSES + op._OTHER):
        if kind >= op.CLASSES:
            total += math.exp(model.outputs(h, np.array([kind]), np.array([0]))[0][0])
            continue
        own = np.arange(kind * op.CLASS_WORDS, (kind + 1) * op.CLASS_WORDS)
        total += np.exp(model.outputs(np.repeat(h, len(own), 0), np.full(len(own), kind), own)[0]).sum()
    assert abs(total - 1) < 1e-4
    at, row, kind = v.read([b"w3", b"w1200", b"new,"])
    assert at.tolist() == [3, 1200, -1] and row[0] == 3 and kind[0] == 0 and kind[2] >= op.CLASSES <= kind[1]


def small_vocabulary():
    return op.Vocabulary([b"a", b"b", b"", b"c"], np.array([9, 5, 4, 2]), np.full(op._OTHER, 0.1), 20, 4)


def test_gradients_match_differences(monkeypatch):
    v = small_vocabulary()
    model = op.Model.initial(v)
    rng = np.random.default_rng(1)
    row = rng.integers(0, 4, 64).astype(np.int32)
    kind = np.zeros(64, np.int32)
    h = rng.normal(0, 0.5, (64, op.HIDDEN)).astype(np.float32)
    grad = op.Model.empty()
    _, dh = model.outputs(h, kind, row, grad)
    at, eps = (5, 3), 1e-2
    for sign in (1, -1):
        h[at] += sign * eps
        high = model.outputs(h, kind, row)[0].mean()
        h[at] -= 2 * sign * eps
        low = model.outputs(h, kind, row)[0].mean()
        h[at] += sign * eps
        assert abs(-(high - low) / (2 * sign * eps) - dh[at]) < 1e-4


def test_training_lowers_the_loss_of_a_stream():
    v = small_vocabulary()
    model = op.Model.initial(v)
    doc = np.array([0, 1, 3, 2], np.int32)  # always the same
    row = np.tile(doc, 4000)
    kind = np.zeros(len(row), np.int32)
    before = op.score_documents(model, [doc], [kind[:4]])[0]
    op.train_stream(model, row, kind, np.arange(len(row)) % 4 == 0, 0.05)
    assert op.score_documents(model, [doc], [kind[:4]])[0] > before / 10


def test_lanes_and_windows_do_not_change_scores():
    v = small_vocabulary()
    model = op.Model.initial(v)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 4, n).astype(np.int32) for n in [1, 2, 70, 33, 500, *[5] * 700]]
    kinds = [np.zeros(len(d), np.int32) for d in docs]
    together = op.score_documents(model, docs, kinds)
    for i in (0, 1, 2, 3, 4, 100):
        assert op.score_documents(model, [docs[i]], [kinds[i]])[0] == pytest.approx(together[i], rel=1e-4)


def test_empty_and_nothing_to_train_on(spark):
    assert run(spark, []) == []
    (one,) = run(spark, [(None, "a b")])
    assert (one["n_tokens"], one["n_known"], one["train_tokens"], one["held_out"]) == (3, 0, 0, True)
    assert one["base_score"] == pytest.approx(0.0) and math.isfinite(one["score"])


def test_every_training_document_is_trained_on(spark):
    from pyspark.sql import functions as F

    part = F.pmod(F.xxhash64(F.lit(88), "id"), F.lit(16))
    late = {r["id"] for r in spark.range(1500).where(part >= 2).collect()}
    other = "red green blue black white grey pink brown".split()
    # the second style is in documents of the later hash values only, apart from held out ones
    docs = [(i, " ".join(other[(i + j) % 8] for j in range(60)) if i in late else t) for i, t in chain(1500)]
    found = [r for r in run(spark, docs) if r["held_out"] and r["doc_id"] in late]
    gain = sum(r["score"] - r["base_score"] for r in found) / sum(r["n_tokens"] for r in found)
    assert len(found) > 50 and gain > 0.4


def test_long_shares_are_trained_on_in_stretches(monkeypatch):
    v = small_vocabulary()
    seen = []
    monkeypatch.setattr(op, "STRETCH", 50)
    monkeypatch.setattr(op, "train_stream", lambda model, row, kind, starts, rate: seen.append((len(row), int(starts.sum()))))
    monkeypatch.setattr(op.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    weights = type("W", (), {"value": op.Model.empty().flat.tobytes()})
    texts = ["a b c"] * 70 + [None]
    read = [v.read(tokens(t))[1:] for t in texts]
    packed = [op.pa.array([x[k].astype(kind).tobytes() for x in read], op.pa.binary()) for k, kind in ((0, "<u2"), (1, np.uint8))]
    batches = [op.pa.RecordBatch.from_arrays(packed, names=["row", "kind"])]
    (out,) = op._trainer(weights, 0.05)(iter(batches))
    assert sum(n for n, _ in seen) == 281 == out.column(1)[0].as_py() and sum(d for _, d in seen) == 71
    assert len(seen) > 3 and all(50 <= n < 104 for n, _ in seen)


def plain_score(model, v, words, counts):
    """log10 probability of a text by the definition: one token at a time, probabilities over the whole vocabulary."""
    big = lambda x: x.astype(np.float64)
    table, state, to_class, to_word = map(big, (model.table, model.state, model.to_class, model.to_word))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    k, h, fed, total = op.HIDDEN, np.zeros(op.HIDDEN), op.START, 0.0
    own = {w: i for i, w in enumerate(v.words[: v.own])}
    for w in words:
        x, g = table[fed], h @ state
        z, r = sigmoid(x[:k] + g[:k]), sigmoid(x[k : 2 * k] + g[k : 2 * k])
        n = np.tanh(x[2 * k :] + r * g[2 * k :])
        h = (1 - z) * n + z * h
        classes = np.exp(h @ to_class + model.class_bias)
        classes /= classes.sum()
        if w in own:
            at = own[w]
            first = at // op.CLASS_WORDS * op.CLASS_WORDS
            inside = np.exp(to_word[first : first + op.CLASS_WORDS] @ h + model.word_bias[first : first + op.CLASS_WORDS])
            total += math.log10(classes[at // op.CLASS_WORDS] * inside[at - first] / inside.sum())
            fed = at
        else:
            other = op.other_class(w)
            total += math.log10(classes[op.CLASSES + other] * (counts.get(w, 0) + 0.1) / v.other_mass[other])
            fed = op.MODEL_WORDS + other
    return total


def test_scores_against_a_plain_model(monkeypatch):
    """``score`` of whole documents, words that are known, looked up by the join, or new."""
    monkeypatch.setattr(op, "MODEL_WORDS", 64)  # so that there are others
    monkeypatch.setattr(op, "CLASSES", 2)
    monkeypatch.setattr(op, "ROWS_IN", 64 + op._OTHER + 1)
    monkeypatch.setattr(op, "START", 64 + op._OTHER)
    sizes = {"table": (op.ROWS_IN, 3 * op.HIDDEN), "to_class": (op.HIDDEN, 2 + op._OTHER), "class_bias": (2 + op._OTHER,), "to_word": (64, op.HIDDEN), "word_bias": (64,)}
    monkeypatch.setattr(op, "SHAPES", [(n, sizes.get(n, shape)) for n, shape in op.SHAPES])
    docs = chain(150) + [(i, f"rare{i % 50} word é{i % 9}, w3 new{i} end.") for i in range(150, 400)] + [(500, None), (501, "w1 " * 3000)]
    counts = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    training = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    known = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:70]
    mass = np.full(op._OTHER, 0.1)
    for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[64:]:
        mass[op.other_class(w)] += c + 0.1
    v = op.Vocabulary([w for w, _ in known], np.array([c for _, c in known]), mass, sum(counts.values()), len(counts))
    model = op.Model.initial(v)
    read = [v.read(tokens(t)) for _, t in training]
    starts = np.concatenate([np.arange(len(r[1])) == 0 for r in read])
    op.train_stream(model, np.concatenate([r[1] for r in read]), np.concatenate([r[2] for r in read]), starts, 0.05)
    monkeypatch.setattr(op, "_vocabulary", lambda shared: v)
    monkeypatch.setattr(op.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    weights = type("W", (), {"value": model.flat.tobytes()})
    batch = op.pa.RecordBatch.from_arrays([op.pa.array([i for i, _ in docs], op.pa.int64()), op.pa.array([t for _, t in docs], op.pa.string())], names=["doc_id", "text"])
    got, far = {}, {}
    read = op.pa.Table.from_batches(op._reader(None)(iter([batch])))
    for r in read.to_pylist():
        far[r["row_id"]] = sum(f["times"] * math.log10(counts.get(f["word"], 0) + 0.1) for f in r["far"])
    names = [c.split()[0] for c in op.PASSED.split(", ")]
    for b in op._scorer(weights)(iter(read.select([*names, "row", "kind"]).to_batches(max_chunksize=100))):
        for r in b.to_pylist():
            got[r["doc_id"]] = r["log_model"] + r["log_shares"] + far[r["row_id"]]
    assert len(got) == len(docs)
    for i, t in docs:
        assert got[i] == pytest.approx(plain_score(model, v, tokens(t), counts), rel=1e-4), i


def test_means_by_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    flats = rng.normal(0, 1, (70, 5)).astype(np.float32)
    rows = [(i, float(1 + i % 4), f.tobytes()) for i, f in enumerate(flats) if i != 40]
    df = spark.createDataFrame(rows, "part int, n double, weights binary")
    want = np.average(np.delete(flats, 40, 0), axis=0, weights=[r[1] for r in rows])
    assert np.allclose(op.tree_mean(df), want, atol=1e-6)
    assert op.tree_mean(df.limit(0)) is None


def test_a_word_of_any_length_is_counted(spark):
    long = "x" * 100_000
    docs = [(i, f"{long} a b" if i % 2 else "a b") for i in range(40)]
    assert digest(run(spark, docs)) == brute(docs)


def test_classes_of_many_words():
    rng = np.random.default_rng(4)
    parts = [b"a", b"Z", b"0", b".", b",", b"-", b"\xc3", b"\xa4", b"\xbc", b"\xb1", b"\xa1", b"\xa9", b"\xe4\xb8\xad", b"longer than"]
    words = [b"", b"\xc3", b"\xa4", *(b"".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(0, 7, 5000))]
    assert op.other_classes(words).tolist() == [op.other_class(w) for w in words]
    assert op.other_classes([]).tolist() == [] and op.other_classes([b""]).tolist() == [op.other_class(b"")]


def test_work_comes_in_large_pieces(monkeypatch):
    """Neither many short documents nor a long one cost a call of the costly parts for every few tokens."""
    v, calls = small_vocabulary(), []
    read, outputs = op.Vocabulary.read, op.Model.outputs
    monkeypatch.setattr(op.Vocabulary, "read", lambda self, words: calls.append(len(words)) or read(self, words))
    monkeypatch.setattr(op.Model, "outputs", lambda self, h, *rest: calls.append(len(h)) or outputs(self, h, *rest))
    monkeypatch.setattr(op, "_vocabulary", lambda shared: v)
    monkeypatch.setattr(op.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    docs = op.pa.RecordBatch.from_arrays([op.pa.array(range(400), op.pa.int64()), op.pa.array(["a b d"] * 400)], names=["doc_id", "text"])
    assert sum(b.num_rows for b in op._reader(None)(iter([docs]))) == 400
    assert len(calls) < 5 and sum(calls) == 1600
    calls.clear()
    long = np.zeros(20_000, np.int32)
    op.score_documents(op.Model.initial(v), [long, long[:3]], [long, long[:3]])
    assert len(calls) < 10 and sum(calls) == 20_003


def plain_training(model, row, kind, starts, rate, lanes):
    """``train_stream`` by the definition: one token at a time, in double precision."""
    k, length = op.HIDDEN, len(row) // lanes
    w = {n: getattr(model, n).astype(np.float64) for n, _ in op.SHAPES}
    first, second = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    h = np.zeros((lanes, k))
    windows = [*range(0, length, op.STEPS)] * max(1, -(-op.UPDATES * op.STEPS // length))
    for t, a in enumerate(windows, 1):
        b = min(a + op.STEPS, length)
        grad, n = {name: np.zeros_like(x) for name, x in w.items()}, (b - a) * lanes
        for lane in range(lanes):
            past = []
            for i in range(a, b):
                at = lane * length + i
                opens = i == 0 or starts[at]
                fed, old = (op.START, np.zeros(k)) if opens else (row[at - 1], h[lane].copy())
                x, g = w["table"][fed], old @ w["state"]
                z, r = sigmoid(x[:k] + g[:k]), sigmoid(x[k : 2 * k] + g[k : 2 * k])
                new = np.tanh(x[2 * k :] + r * g[2 * k :])
                h[lane] = (1 - z) * new + z * old
                past.append((at, opens, fed, old, g[2 * k :], z, r, new, h[lane].copy()))
            back = np.zeros(k)
            for at, opens, fed, old, g, z, r, new, state in reversed(past):
                p = softmax(state @ w["to_class"] + w["class_bias"])
                p[kind[at]] -= 1
                grad["to_class"] += np.outer(state, p) / n
                grad["class_bias"] += p / n
                back = back + w["to_class"] @ p / n
                if kind[at] < op.CLASSES:
                    own = slice(kind[at] * op.CLASS_WORDS, (kind[at] + 1) * op.CLASS_WORDS)
                    q = softmax(w["to_word"][own] @ state + w["word_bias"][own])
                    q[row[at] - own.start] -= 1
                    grad["to_word"][own] += np.outer(q, state) / n
                    grad["word_bias"][own] += q / n
                    back += q @ w["to_word"][own] / n
                dn = back * (1 - z) * (1 - new * new)
                dx = np.concatenate([back * (old - new) * z * (1 - z), dn * g * r * (1 - r), dn])
                dg = np.concatenate([dx[: 2 * k], dn * r])
                grad["table"][fed] += dx
                grad["state"] += np.outer(old, dg)
                back = np.zeros(k) if opens else back * z + w["state"] @ dg
        norm = math.sqrt(sum((x * x).sum() for x in grad.values()))
        for name, x in grad.items():
            x /= max(norm, 1)
            first[name] = 0.9 * first[name] + 0.1 * x
            second[name] = 0.99 * second[name] + 0.01 * x * x
            warm = rate * min(1.0, t / 10) * (1 - 0.8 * t / len(windows))
            w[name] -= warm * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-6)
    return w


@pytest.mark.parametrize("updates, lanes", [(2, 10), (4, 8)])  # one pass and two, each with a short last window
def test_training_against_a_plain_one(monkeypatch, updates, lanes):
    monkeypatch.setattr(op, "UPDATES", updates)
    rng = np.random.default_rng(5)
    model = op.Model(rng.normal(0, 0.3, len(op.Model.empty().flat)).astype(np.float32))
    before = op.Model(model.flat.copy())
    row = np.where(rng.random(350) < 0.5, rng.integers(0, op.MODEL_WORDS, 350), rng.integers(op.MODEL_WORDS, op.START, 350))
    kind = np.where(row < op.MODEL_WORDS, row // op.CLASS_WORDS, row - op.MODEL_WORDS + op.CLASSES)
    starts = rng.random(350) < 0.1
    want = plain_training(model, row, kind, starts, 0.05, lanes)
    op.train_stream(model, row.astype(np.uint16), kind.astype(np.uint8), starts, 0.05)
    for name, _ in op.SHAPES:
        moved = np.abs(want[name] - getattr(before, name)).max()
        assert moved > 0.01 and np.abs(want[name] - getattr(model, name)).max() < 0.01 * moved, name


def test_large_biases_change_nothing():
    rng = np.random.default_rng(6)
    model = op.Model(rng.normal(0, 0.3, len(op.Model.empty().flat)).astype(np.float32))
    high = op.Model(model.flat.copy())
    high.class_bias += 200
    high.word_bias += 200
    assert model.tame and not high.tame
    h, word = rng.normal(0, 0.5, (3000, op.HIDDEN)).astype(np.float32), rng.integers(0, op.MODEL_WORDS, 3000)
    kind = np.where(rng.random(3000) < 0.5, word // op.CLASS_WORDS, op.CLASSES + word % op._OTHER)
    assert np.allclose(model.outputs(h, kind, word)[0], high.outputs(h, kind, word)[0], atol=1e-3)
    grads = op.Model.empty(), op.Model.empty()
    by_state = [m.outputs(h, kind, word, g)[1] for m, g in zip((model, high), grads, strict=True)]
    assert np.allclose(*by_state, atol=1e-6) and np.allclose(grads[0].flat, grads[1].flat, atol=1e-4)
