"""Scoring of documents by a gated recurrent language model.

*Counts.* Every training document's tokens are counted - per task first, then by a shuffle - and
the table of counts is written to the shared folder. Tokens above a count that at most
``KNOWN`` tokens reach go to every task with their counts; the others are looked up by a join,
once for each document, so vocabulary never has to fit anywhere and every count is exact.

*Reading.* Every document is read once more with the vocabulary; the table of its tokens' input rows and
output classes, three bytes a token, is what training and scoring go through.

*Model.* The ``MODEL_WORDS`` most frequent tokens form classes of ``CLASS_WORDS``; all other
words fall into classes by their letters, ending and length. The output is factored: a softmax
over classes, then a softmax over the words of the class, or, in classes of other words, their
smoothed share (c + 0.1) of the class by the counts of the whole corpus, with one more 0.1 for
words not seen. The biases start at the counts, so the model starts at the unigram base and
training moves it on. Input of a word is its row, or its class's, in a table.

*Training.* Truncated backpropagation over windows of ``STEPS`` tokens in numpy, state carried
from window to window. A round takes a ``1 / SLICES`` part of the training documents by a hash
of the id, and there are as many rounds as parts, so every training document is trained on once:
every task trains on its share from the same start, in stretches of bounded length, and the
weights are averaged by a tree, ``FAN_IN`` tasks at a time.

*Scoring.* A task lays its documents end to end in lanes of about equal length, longest first,
and runs all lanes step by step; state is carried across windows and cleared where a document
starts. The whole document counts, its end included.

Defined results: a null text is empty and has its end as only token; a null id counts as held
out; equal rows are scored each; without training tokens every word has the count 0; other
columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import persist_table
from ..session import ship_package
from .common import table

HIDDEN = 24
MODEL_WORDS, CLASS_WORDS = 1024, 32
CLASSES = MODEL_WORDS // CLASS_WORDS
KNOWN, KNOWN_BYTES = 1 << 19, 128
STEPS, LANES = 16, 512
#: States whose class probabilities are held at once.
BLOCK = 1024
#: Training: most lanes, and the updates that a stream should give at least, by several passes if it is short.
TRAIN_LANES, UPDATES = 256, 128
#: Parts of the training documents, one for each round.
SLICES = 4
#: Tokens that a task trains on together; the last stretch has up to twice as many.
STRETCH = 1 << 20
#: Weights that one task averages.
FAN_IN = 32
#: Tokens that a task scores together, and that it reads into one batch.
BATCH_TOKENS, READ_TOKENS = 1 << 21, 1 << 16
END = b""

_OTHER = 40
_UMLAUT = re.compile(b"\xc3[\xa4\xb6\xbc\x9f]")
_SPANISH = re.compile(b"\xc3[\xb1\xb3\xad\xa1\xba]")


def other_class(word: bytes) -> int:
    """Class of a word that is not among the model's own: letters, ending, length."""
    if word.isascii():
        letters = 0
    elif b"\xc3" not in word:
        letters = 4
    else:
        letters = 1 if _UMLAUT.search(word) else 2 if _SPANISH.search(word) else 3
    last = word[-1:]
    ending = 1 if last == b"." else 2 if last == b"," else 0 if last.isalnum() or last >= b"\x80" else 3
    return (letters * 4 + ending) * 2 + (len(word) > 8)


#: By last byte: 1 and 2 for stop and comma, 0 for letters, digits and bytes beyond ASCII, else 3.
_ENDING = np.array([1 if i == 46 else 2 if i == 44 else 0 if i >= 128 or chr(i).isalnum() else 3 for i in range(256)], np.uint8)
_AFTER_C3 = np.zeros(256, np.uint8)
_AFTER_C3[list(b"\xa4\xb6\xbc\x9f")] = 1
_AFTER_C3[list(b"\xb1\xb3\xad\xa1\xba")] = 2


def other_classes(words: list[bytes]) -> np.ndarray:
    """``other_class`` of every word."""
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    ending = np.full(len(words), 3, np.uint8)
    some = lengths > 0
    ending[some] = _ENDING[data[ends[some] - 1]]
    letters = np.zeros(len(words), np.uint8)
    beyond = np.flatnonzero(data >= 0x80)
    of = np.searchsorted(ends, beyond, side="right")
    letters[of] = 4
    lead = data[beyond] == 0xC3
    of, after = of[lead], beyond[lead] + 1
    letters[of] = 3
    inside = after < ends[of]
    sort = np.zeros(len(of), np.uint8)
    sort[inside] = _AFTER_C3[data[after[inside]]]
    for mark in (2, 1):  # an umlaut decides
        letters[of[sort == mark]] = mark
    return (letters * 4 + ending) * 2 + (lengths > 8)


def tokens(text: pa.Buffer | None) -> list[bytes]:
    """Words, then the end. On bytes, lower() and split() know A-Z and the contract's white space only."""
    words = text.to_pybytes().lower().split() if text is not None else []
    words.append(END)
    return words


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen.clear()
        return b

    for b in batches:
        for t in b.column(0):
            seen.update(tokens(t.as_buffer()))
            if len(seen) > 1 << 19:
                yield out()
    yield out()


def _other_masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        mass = np.zeros(_OTHER)
        if b.num_rows:
            kinds = other_classes(b.column(0).to_pylist())
            mass += np.bincount(kinds, b.column(1).to_numpy() + 0.1, _OTHER)
        yield pa.RecordBatch.from_arrays([pa.array(range(_OTHER), pa.int32()), pa.array(mass)], names=["kind", "mass"])


class Vocabulary:
    """Known words by falling count, the first of them the model's; from bytes and back."""

    def __init__(self, words: list[bytes], counts: np.ndarray, other_mass: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.other_mass = words, counts, other_mass
        self.total, self.distinct = total, distinct
        self.own = min(MODEL_WORDS, len(words))

    @functools.cached_property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @functools.cached_property
    def kind(self) -> np.ndarray:
        """Output class by word: the model's own first, then the classes of other words."""
        return np.concatenate([np.arange(self.own) // CLASS_WORDS, CLASSES + other_classes(self.words[self.own :])]).astype(np.uint8)

    @functools.cached_property
    def row(self) -> np.ndarray:
        """Input row by word."""
        at = np.arange(len(self.words))
        return np.where(at < self.own, at, MODEL_WORDS - CLASSES + self.kind.astype(np.int64)).astype(np.uint16)

    @functools.cached_property
    def log_count(self) -> np.ndarray:
        return np.log10(self.counts + 0.1)

    @functools.cached_property
    def log_mass(self) -> np.ndarray:
        return np.log10(self.other_mass)

    @functools.cached_property
    def log_share(self) -> np.ndarray:
        """Of its class, by word; nothing for the model's own."""
        out = np.zeros(len(self.words))
        out[self.own :] = self.log_count[self.own :] - self.log_mass[self.kind[self.own :] - CLASSES]
        return out

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index (-1: not known), input row and output class of every word."""
        at = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int32, len(words))
        far = np.flatnonzero(at < 0)
        row, kind = (self.row[at], self.kind[at]) if len(self.words) else (np.zeros(len(words), np.uint16), np.zeros(len(words), np.uint8))
        if len(far):
            own = other_classes([words[i] for i in far.tolist()])
            row[far] = MODEL_WORDS + own.astype(np.uint16)
            kind[far] = CLASSES + own
        return at, row, kind


ROWS_IN = MODEL_WORDS + _OTHER + 1
START = ROWS_IN - 1
SHAPES = [
    ("table", (ROWS_IN, 3 * HIDDEN)),
    ("state", (HIDDEN, 3 * HIDDEN)),
    ("to_class", (HIDDEN, CLASSES + _OTHER)),
    ("class_bias", (CLASSES + _OTHER,)),
    ("to_word", (MODEL_WORDS, HIDDEN)),
    ("word_bias", (MODEL_WORDS,)),
]


class Model:
    def __init__(self, weights: np.ndarray):
        self.flat = weights
        at = 0
        for name, shape in SHAPES:
            n = math.prod(shape)
            setattr(self, name, weights[at : at + n].reshape(shape))
            at += n

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros(sum(math.prod(s) for _, s in SHAPES), np.float32))

    @classmethod
    def initial(cls, v: Vocabulary) -> Model:
        """The unigram base in factored form, with small random weights."""
        m, rng = cls.empty(), np.random.default_rng(8)
        m.table[:] = rng.normal(0, 0.1, m.table.shape)
        m.state[:] = rng.normal(0, 0.5 / math.sqrt(HIDDEN), m.state.shape)
        m.to_class[:] = rng.normal(0, 0.05, m.to_class.shape)
        m.to_word[:] = rng.normal(0, 0.05, m.to_word.shape)
        own = np.zeros(MODEL_WORDS)
        own[: v.own] = v.counts[: v.own] + 0.1
        mass = np.concatenate([own.reshape(CLASSES, CLASS_WORDS).sum(axis=1), v.other_mass])
        with np.errstate(divide="ignore"):
            m.class_bias[:] = np.maximum(np.log(mass / mass.sum()), -30)
            m.word_bias[:] = np.where(own > 0, np.log(np.maximum(own, 1e-9)), -30) - np.repeat(np.log(np.maximum(mass[:CLASSES], 1e-9)), CLASS_WORDS)
        m.word_bias[v.own :] = -30
        return m

    @property
    def tame(self) -> bool:
        """Whether no output can overflow, states being within 1; else maxima are taken off first."""
        most = (np.abs(w).sum(axis=a).max() + np.abs(b).max() for w, a, b in ((self.to_class, 0, self.class_bias), (self.to_word, 1, self.word_bias)))
        return max(most) < 60

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Copies of the input table and the recurrent weights with one block for each of update, reset and new
        state, so that work on a gate is on contiguous numbers; the first two halved, for ``step``."""
        table = np.ascontiguousarray(self.table.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))
        state = np.ascontiguousarray(self.state.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
        table[:2] *= 0.5
        state[:2] *= 0.5
        return table, state

    def outputs(self, h: np.ndarray, kind: np.ndarray, word: np.ndarray, grad: Model | None = None):
        """Natural log probabilities of (class, word within an own class) after states ``h``; ``word`` is the
        row of an own word. With ``grad``, instead of them, gradients of their mean, negated, by weight and state.

        Own words are sorted by class, so a class is a slice; a column of ones carries the biases. Classes are
        done in blocks of ``BLOCK`` states, which stay in cache."""
        n, tame = len(h), self.tame
        kind = kind.astype(np.uint8)
        wide = np.empty((n, HIDDEN + 1), np.float32)
        wide[:, :HIDDEN] = h
        wide[:, HIDDEN] = 1
        out = np.empty(n) if grad is None else None
        dh = np.empty_like(h) if grad is not None else None

        to_class = np.vstack([self.to_class, self.class_bias])
        ones = np.ones(to_class.shape[1], np.float32)
        whole = np.empty((min(n, BLOCK), len(ones)), np.float32)
        for a in range(0, n, BLOCK):
            at = slice(a, min(a + BLOCK, n))
            p = np.matmul(wide[at], to_class, out=whole[: at.stop - a])
            if not tame:
                p -= p.max(axis=1, keepdims=True)
            hit = np.arange(0, p.size, len(ones)) + kind[at]
            if grad is None:
                right = p.ravel()[hit]
            np.exp(p, out=p)
            total = p @ ones
            if grad is None:
                out[at] = right - np.log(total)
                continue
            p.ravel()[hit] -= total
            share = (1 / (n * total))[:, None]
            by_class = (wide[at] * share).T @ p
            grad.to_class += by_class[:HIDDEN]
            grad.class_bias += by_class[HIDDEN]
            np.multiply(p @ self.to_class.T, share, out=dh[at])

        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
        order = order[: bounds[-1]]
        spans = [(c, slice(a, b)) for c, (a, b) in enumerate(itertools.pairwise(bounds)) if a < b]
        own = wide[order]
        to_word = np.concatenate([self.to_word, self.word_bias[:, None]], axis=1).reshape(CLASSES, CLASS_WORDS, HIDDEN + 1)
        q = np.empty((len(order), CLASS_WORDS), np.float32)
        for c, at in spans:
            np.matmul(own[at], to_word[c].T, out=q[at])
        if not tame:
            q -= q.max(axis=1, keepdims=True)
        hit = np.arange(0, q.size, CLASS_WORDS) + word[order] % CLASS_WORDS
        if grad is None:
            right = q.ravel()[hit]
        np.exp(q, out=q)
        total = q @ np.ones(CLASS_WORDS, np.float32)
        if grad is None:
            out[order] += right - np.log(total)
            return out, None
        q.ravel()[hit] -= total
        q *= (1 / (n * total))[:, None]
        by_word = np.zeros_like(to_word)
        back = np.empty_like(own)
        for c, at in spans:
            np.matmul(q[at].T, own[at], out=by_word[c])
            np.matmul(q[at], to_word[c], out=back[at])
        by_word = by_word.reshape(-1, HIDDEN + 1)
        grad.to_word += by_word[:, :HIDDEN]
        grad.word_bias += by_word[:, HIDDEN]
        dh[order] += back[:, :HIDDEN]
        return None, dh


def step(x: np.ndarray, h: np.ndarray, state: np.ndarray, g: np.ndarray, zr: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """State ``out`` after ``h`` and the inputs ``x``, weights being those of ``Model.gates``. ``g``, ``zr`` and
    ``n`` receive what the gates get from the state, update and reset, and the new state."""
    np.matmul(h, state, out=g)
    np.add(x[:2], g[:2], out=zr)
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    np.multiply(zr[1], g[2], out=n)
    n += x[2]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= zr[0]
    out += n


def sums_by_row(values: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Adds ``values`` to the rows of ``out`` that ``rows`` names."""
    rows = rows.astype(np.uint16)
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    firsts = np.flatnonzero(np.diff(rows.astype(np.int32), prepend=-1))
    out[rows[firsts]] += np.add.reduceat(values[order], firsts, axis=0)


def train_stream(model: Model, row: np.ndarray, kind: np.ndarray, starts: np.ndarray, rate: float) -> None:
    """Passes over a stream of tokens, in place. ``starts``: whether a document starts there.
    Lanes are chosen so that one pass gives ``UPDATES``; a short stream has several passes."""
    lanes = int(min(TRAIN_LANES, max(8, len(row) // (STEPS * UPDATES))))
    length = len(row) // lanes
    if length < 2:
        return
    cut = [a[: lanes * length].reshape(lanes, length).T for a in (row, kind, starts)]
    row, kind, starts = map(np.ascontiguousarray, cut)
    starts[0] = True
    feed = np.vstack([np.full((1, lanes), START, row.dtype), row[:-1]])
    feed[starts] = START
    last = np.zeros((lanes, HIDDEN), np.float32)
    first, second = Model.empty(), Model.empty()
    grad, spare = Model.empty(), np.empty_like(model.flat)
    # by step: state before and after, gates; then their gradients, one block of lanes for each gate
    by_step = np.empty((8, STEPS, lanes, HIDDEN), np.float32)
    old, states, new, by_n, by_z, by_r = by_step[:6]
    keep = by_step[6]
    zr, g, dg = (np.empty((STEPS, k, lanes, HIDDEN), np.float32) for k in (2, 3, 3))
    to_old = np.empty((3, lanes, HIDDEN), np.float32)
    windows = [*range(0, length, STEPS)] * max(1, -(-UPDATES * STEPS // length))
    for t, a in enumerate(windows, 1):
        b = min(a + STEPS, length)
        k = b - a
        table, state = model.gates()
        x = np.take(table, feed[a:b], axis=1)
        opened = [np.flatnonzero(s) for s in starts[a:b]]
        for i in range(k):
            old[i] = last
            old[i, opened[i]] = 0
            last = states[i]
            step(x[:, i], old[i], state, g[i], zr[i], new[i], last)
        last = last.copy()
        grad.flat[:] = 0
        _, dh_out = model.outputs(states[:k].reshape(-1, HIDDEN), kind[a:b].ravel(), row[a:b].ravel(), grad)
        dh_out = dh_out.reshape(k, lanes, HIDDEN)
        z, r = zr[:k, 0], zr[:k, 1]
        # by_n = (1 - z)(1 - n n), by_z = (old - n) z (1 - z), by_r = gn r (1 - r)
        np.subtract(1, z, out=keep[:k])
        np.multiply(new[:k], new[:k], out=by_n[:k])
        np.subtract(1, by_n[:k], out=by_n[:k])
        by_n[:k] *= keep[:k]
        np.subtract(old[:k], new[:k], out=by_z[:k])
        by_z[:k] *= z
        by_z[:k] *= keep[:k]
        np.subtract(1, r, out=by_r[:k])
        by_r[:k] *= r
        by_r[:k] *= g[:k, 2]
        state[:2] *= 2
        back = state.transpose(0, 2, 1)
        dx_n = by_step[7]
        dh = np.zeros((lanes, HIDDEN), np.float32)
        for i in range(k - 1, -1, -1):
            dh += dh_out[i]
            d, dn = dg[i], dx_n[i]
            np.multiply(dh, by_n[i], out=dn)
            np.multiply(dh, by_z[i], out=d[0])
            np.multiply(dn, by_r[i], out=d[1])
            np.multiply(dn, r[i], out=d[2])
            np.matmul(d, back, out=to_old)
            dh *= z[i]
            dh += to_old[0]
            dh += to_old[1]
            dh += to_old[2]
            dh[opened[i]] = 0
        dx = np.empty((k, lanes, 3, HIDDEN), np.float32)
        dx[:, :, :2] = dg[:k, :2].transpose(0, 2, 1, 3)
        dx[:, :, 2] = dg[:k, 2]
        flat = old[:k].reshape(-1, HIDDEN).T
        grad.state += flat @ dx.reshape(-1, 3 * HIDDEN)
        dx[:, :, 2] = dx_n[:k]
        sums_by_row(dx.reshape(-1, 3 * HIDDEN), feed[a:b].ravel(), grad.table)
        norm = float(np.linalg.norm(grad.flat))
        if norm > 1:
            grad.flat /= norm
        # Adam; the moments lack their factors 0.1 and 0.01, which the corrections for the start have instead
        first.flat *= 0.9
        first.flat += grad.flat
        second.flat *= 0.99
        np.multiply(grad.flat, grad.flat, out=spare)
        second.flat += spare
        warm = rate * min(1.0, t / 10) * (1 - 0.8 * t / len(windows))
        np.multiply(second.flat, 0.01 / (1 - 0.99**t), out=spare)
        np.sqrt(spare, out=spare)
        spare += 1e-6
        np.divide(first.flat, spare, out=spare)
        spare *= warm * 0.1 / (1 - 0.9**t)
        model.flat -= spare


def score_documents(model: Model, rows: list[np.ndarray], kinds: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of classes and own words, summed by document."""
    lengths = np.array([len(r) for r in rows])
    lanes = min(LANES, len(rows))
    queues: list[list[int]] = [[] for _ in range(lanes)]
    load = np.zeros(lanes, np.int64)
    for d in np.argsort(-lengths, kind="stable"):
        lane = int(np.argmin(load))
        queues[lane].append(int(d))
        load[lane] += lengths[d]
    order = np.argsort(-load, kind="stable")
    depth = int(load.max())
    row = np.zeros((depth, lanes), np.uint16)
    kind = np.zeros((depth, lanes), np.uint8)
    doc = np.zeros((depth, lanes), np.int32)
    starts = np.zeros((depth, lanes), bool)
    for place, lane in enumerate(order):
        at = 0
        for d in queues[lane]:
            end = at + lengths[d]
            row[at:end, place], kind[at:end, place], doc[at:end, place] = rows[d], kinds[d], d
            starts[at, place] = True
            at = end
    active = np.searchsorted(-load[order], -np.arange(1, depth + 1), side="right")  # lanes with a token at each step
    feed = np.vstack([np.full((1, lanes), START, row.dtype), row[:-1]])
    feed[starts] = START
    table, state = model.gates()
    last = np.zeros((lanes, HIDDEN), np.float32)
    out = np.zeros(len(rows))
    b = 0
    while b < depth:
        a, width = b, int(active[b])
        b = min(a + STEPS * LANES // width, depth)  # fewer lanes, more steps
        x = np.take(table, feed[a:b, :width], axis=1)
        last = last[:width]
        states = np.empty((b - a, width, HIDDEN), np.float32)
        zr, g = (np.empty((k, width, HIDDEN), np.float32) for k in (2, 3))
        new = np.empty((width, HIDDEN), np.float32)
        for i in range(b - a):
            opened = np.flatnonzero(starts[a + i, :width])
            if len(opened):
                last = last.copy()
                last[opened] = 0
            step(x[:, i], last, state, g, zr, new, states[i])
            last = states[i]
        live = np.arange(width) < active[a:b, None]
        logs, _ = model.outputs(states[live], kind[a:b, :width][live], row[a:b, :width][live])
        out += np.bincount(doc[a:b, :width][live], logs, len(rows))
    return out


#: The last vocabulary with its derived tables, built once in a Python worker, by the key it was sent with.
_loaded: dict[str, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    words, counts, mass, total, distinct, key = shared.value
    found = _loaded.get(key)
    if found is None:
        _loaded.clear()
        ends = np.cumsum(np.frombuffer(counts[1], np.int32))
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        listed = [words[a:b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
        found = _loaded[key] = Vocabulary(listed, np.frombuffer(counts[0], np.int64), np.frombuffer(mass, np.float64), total, distinct)
    return found


def build_vocabulary(counts: DataFrame) -> tuple:
    """What tasks get: words joined, (counts, lengths), masses of other classes, N, V, a key of its own.
    At most ``KNOWN`` words of at most ``KNOWN_BYTES`` each."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    fine = F.floor(F.ln("n") * 64).cast("int")
    short = counts.where(F.octet_length("word") <= KNOWN_BYTES)
    bins = sorted(((r[0], r[1]) for r in short.groupBy(fine.alias("b")).count().collect()), reverse=True)
    room, least = KNOWN, None
    for b, n in bins:  # whole bins only, so the bound holds and no order among equals is needed
        room -= n
        if room < 0:
            break
        least = b
    frequent = short.where(fine >= least) if least is not None else counts.limit(0)
    got = frequent.select("word", "n").toArrow()
    pairs = sorted(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    words, n = [w for w, _ in pairs], np.array([c for _, c in pairs], np.int64)
    mass = np.full(_OTHER, 0.1)
    for r in counts.select("word", "n").mapInArrow(_other_masses, "kind int, mass double").groupBy("kind").agg(F.sum("mass")).collect():
        mass[r[0]] += r[1]
    for w, c in pairs[:MODEL_WORDS]:
        mass[other_class(w)] -= c + 0.1
    mass = np.maximum(mass, 0.1)
    lengths = np.array([len(w) for w in words], np.int32)
    return b"".join(words), (n.tobytes(), lengths.tobytes()), mass.tobytes(), int(total), int(distinct), uuid.uuid4().hex


READ = (
    "row_id long, doc_id long, n_tokens long, n_known long, log_counts double, log_shares double,"
    " far array<struct<word: binary, times: int>>, row binary, kind binary"
)


def _reader(shared):
    """Documents as the model sees them: input rows and output classes of their tokens, two bytes and
    one each; what the counts of known words give; and the words to look up."""
    entry = pa.struct([("word", pa.binary()), ("times", pa.int32())])
    names = ["row_id", "doc_id", "n_tokens", "n_known", "log_counts", "log_shares", "far", "row", "kind"]

    def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], ends]) * data.itemsize
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        number = itertools.count(TaskContext.get().partitionId() << 33)
        docs: list[int | None] = []
        lengths: list[int] = []
        words: list[bytes] = []

        def out() -> pa.RecordBatch:
            """The documents held, read together."""
            n = np.array(lengths, np.int64)
            ends = np.cumsum(n)
            begin = ends - n
            at, row, kind = v.read(words)
            known = at >= 0
            by_count, by_share = np.zeros(len(at)), np.zeros(len(at))
            by_count[known] = v.log_count[at[known]]
            # log10 of (c + 0.1) of known words outside the model's own over their class's; unknown ones' c comes by the join
            by_share[known] = v.log_share[at[known]]
            by_share[~known] = -v.log_mass[kind[~known] - CLASSES]
            sums = [np.add.reduceat(x, begin) if len(n) else x for x in (known.astype(np.int64), by_count, by_share)]
            places = np.flatnonzero(~known)
            far = [words[i] for i in places.tolist()]
            bounds = np.concatenate([[0], np.searchsorted(places, ends)]).tolist()
            counted = [Counter(far[a:b]) for a, b in itertools.pairwise(bounds)]
            listed = pa.array([w for c in counted for w in c], pa.binary())
            times = pa.array([t for c in counted for t in c.values()], pa.int32())
            offsets = pa.array(np.cumsum([0, *map(len, counted)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([listed, times], fields=list(entry)))
            ids = pa.array([next(number) for _ in docs], pa.int64())
            arrays = [ids, pa.array(docs, pa.int64()), pa.array(n), *map(pa.array, sums), lists, binaries(row.astype("<u2", copy=False), ends), binaries(kind, ends)]
            for held in (docs, lengths, words):
                held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = tokens(text.as_buffer())
                docs.append(doc)
                lengths.append(len(found))
                words += found
                if len(words) >= READ_TOKENS:
                    yield out()
        yield out()

    return run


def unpacked(row: pa.Scalar, kind: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.as_buffer(), "<u2"), np.frombuffer(kind.as_buffer(), np.uint8)


def _trainer(weights, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(np.frombuffer(weights.value, np.float32).copy())
        held: list[tuple[np.ndarray, ...]] = []
        n = size = 0

        def train(upto: int) -> int:
            """Trains on the first documents that have ``upto`` tokens together; returns their tokens."""
            ends = np.cumsum([len(h[0]) for h in held])
            k = int(np.searchsorted(ends, upto)) + 1
            train_stream(model, *map(np.concatenate, zip(*held[:k], strict=True)), rate)
            del held[:k]
            return int(ends[min(k, len(ends)) - 1])

        for b in batches:
            for packed in zip(b.column(0), b.column(1), strict=True):
                row, kind = unpacked(*packed)
                first = np.zeros(len(row), bool)
                first[0] = True
                held.append((row, kind, first))
                n += len(row)
                size += len(row)
                if size >= 2 * STRETCH:
                    size -= train(STRETCH)
        if held:
            train(size)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(n)]), pa.array([model.flat.tobytes()], pa.binary())],
                names=["part", "n", "weights"],
            )

    return run


def _mean(rows: pa.Table) -> pa.Table:
    """Mean of at most ``FAN_IN`` weights, in the order of their parts."""
    rows = rows.sort_by("part")
    weight = rows["n"].to_numpy()
    total = sum(n * np.frombuffer(w.as_py(), np.float32).astype(np.float64) for n, w in zip(weight, rows["weights"], strict=True))
    mean = (total / weight.sum()).astype(np.float32)
    part = pa.array([rows["part"][0].as_py() // FAN_IN], pa.int32())
    return pa.table({"part": part, "n": pa.array([float(weight.sum())]), "weights": pa.array([mean.tobytes()], pa.binary())})


def tree_mean(trained: DataFrame) -> np.ndarray | None:
    """``trained``: (part, n, weights) by task. Mean of the weights, none without rows."""
    schema = "part int, n double, weights binary"
    trained = persist_table(trained, "lm-weights")
    last = trained.agg(F.max("part")).first()[0]
    if last is None:
        return None
    while last >= FAN_IN:
        trained = trained.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(_mean, schema)
        last //= FAN_IN
    return np.frombuffer(_mean(trained.toArrow())["weights"][0].as_py(), np.float32)


def fit(read: DataFrame, v: Vocabulary, slices: int = SLICES) -> Model:
    """``read``: (doc_id, row, kind) of training documents. Every one is trained on in one of the rounds."""
    sc = read.sparkSession.sparkContext
    model = Model.initial(v)
    for k in range(slices):
        part = read.where(F.pmod(F.xxhash64(F.lit(88), "doc_id"), F.lit(slices)) == k).select("row", "kind")
        weights = sc.broadcast(model.flat.tobytes())
        mean = tree_mean(part.mapInArrow(_trainer(weights, 0.05 / (k + 1)), "part int, n double, weights binary"))
        if mean is not None:
            model = Model(mean)
    return model


PASSED = "row_id long, doc_id long, n_tokens long, n_known long, log_counts double, log_shares double"


def _scorer(weights):
    """The columns ``PASSED``, and the log10 probability of classes and own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(np.frombuffer(weights.value, np.float32))
        passed: list[pa.RecordBatch] = []
        read: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            logs = score_documents(model, *map(list, zip(*read, strict=True))) / math.log(10)
            for b in passed:
                own, logs = logs[: b.num_rows], logs[b.num_rows :]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.float64())], names=[*b.schema.names, "log_model"])
            passed.clear()
            read.clear()

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                passed.append(part.select(part.schema.names[:-2]))
                for packed in zip(part.column(part.num_columns - 2), part.column(part.num_columns - 1), strict=True):
                    read.append(unpacked(*packed))
                    size += len(read[-1][0])
                if size >= BATCH_TOKENS:
                    yield from out()
                    size = 0
        if read:
            yield from out()

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = rows.where(remainder(F.col("doc_id")) != 0).select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = persist_table(counts, "lm-counts")
    packed = build_vocabulary(counts)
    shared = spark.sparkContext.broadcast(packed)
    v = _vocabulary(shared)
    read = persist_table(rows.mapInArrow(_reader(shared), READ), "lm-read")
    model = fit(read.where(remainder(F.col("doc_id")) != 0), v)
    weights = spark.sparkContext.broadcast(model.flat.tobytes())
    names = [c.split()[0] for c in PASSED.split(", ")]
    scored = read.select(*names, "row", "kind").mapInArrow(_scorer(weights), f"{PASSED}, log_model double")
    far = read.select("row_id", F.inline("far"))
    found = far.join(counts, "word", "left").select(
        "row_id",
        (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("logs"),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("seen"),
    )
    found = found.groupBy("row_id").agg(F.sum("logs").alias("far_logs"), F.sum("seen").alias("far_seen"))
    norm = math.log10(v.total + 0.1 * (v.distinct + 1))
    logs = F.coalesce("far_logs", F.lit(0.0))
    return (
        scored.join(found, "row_id", "left")
        .select(
            F.col("doc_id").alias(id_col),
            (remainder(F.col("doc_id")) == 0).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("far_seen", F.lit(0))).alias("n_known"),
            F.lit(v.total).cast("long").alias("train_tokens"),
            (F.col("log_counts") + logs - F.col("n_tokens") * norm).alias("base_score"),
            (F.col("log_model") + F.col("log_shares") + logs).alias("score"),
        )
    )


def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op8_gru_lm": op8_gru_lm}
ORACLES: dict[str, str] = {}
