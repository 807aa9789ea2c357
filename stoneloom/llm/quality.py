"""Quality classifier from weak labels.

1. *Labellers.* Nine heuristics look at every whole text and vote junk, fine or nothing: words
   dressed with symbols, words of punctuation only, capitals, exclamations, words said again,
   poverty of words, lack of short words, lack of sentence ends, lack of letters. Their votes make a pattern, one
   of at most 3 ** 9, and only the counts of patterns over all documents go to the driver.
2. *Label model.* Expectation-maximisation over the counted patterns estimates the share of junk
   and, for each labeller, how it votes on junk and on fine texts, hence its accuracy; nothing is
   labelled by hand. The posterior of a pattern labels its documents.
3. *Scorer.* A logistic regression over hashed word shapes and pairs of shapes learns the
   posteriors. It is fitted on at most ``2 * sample`` documents, ``sample`` of either likely
   label in expectation, drawn by a hash of the id; features have ``DIMENSIONS`` numbers each, so
   what comes to the driver is bounded. Every document is then scored whole.

The fewer words a text has the less its features say: the scorer's log odds count n of n + ``EVIDENCE``
parts, those of ``BLANK`` the rest. So every text is scored, and a few words need strong evidence against them.

Defined results: a null or blank text scores ``BLANK``, so it stays; a
document is kept unless its score reaches ``threshold``; equal texts score the same; other columns play no
part. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import persist_table
from ..session import ship_package
from .common import table

DIMENSIONS = 1024
SAMPLE = 2048
THRESHOLD = 0.5
#: Codes of words that a Python worker remembers.
CODES = 1 << 17
#: The score of a text of which nothing is known, and the words that weigh as much as this.
BLANK, EVIDENCE = 0.1, 8
#: What is believed of labellers before the votes are seen: the share of fine texts that one calls junk, and the
#: weight of that belief, in times of the fine texts that voted. Without it, kinds of junk that different labellers
#: know would not be taken for one class.
FALSE_ALARMS, BELIEF = 0.001, 8
NONE, FINE, JUNK = 0, 1, 2

# Facts of a word above the bits of its hashed shape; above them the number of its characters that are neither letters nor digits.
OTHERS = 20
SYMBOLS, BARE, CAPITALS, SHOUT, SHORT, ENDS, LETTERS = (1 << (10 + i) for i in range(7))
_SYMBOL = re.compile(r"[#$%&*~^=+<>@|\\_]{2}|[#$%*~^|]")
_RUN = re.compile(r"(.)\1+")


def word_shape(word: str) -> str:
    """Letters by case, digits and other characters as they are, runs of one kind to one sign."""
    signs = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", signs)


def _plain(word: str) -> tuple[str, str] | None:
    """Shape and tail of a word of letters of one common pattern with at most one full stop or comma."""
    tail = word[-1] if word[-1] in ".," else ""
    body = word[:-1] if tail else word
    if not body.isalpha():
        return None
    if body.islower():
        return "a", tail
    if body[0].isupper() and (len(body) == 1 or body[1:].islower()):
        return ("A" if len(body) == 1 else "Aa"), tail
    return None


@functools.lru_cache(1 << 14)
def _shape_code(shape: str) -> int:
    return zlib.crc32(shape.encode()) % DIMENSIONS


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        plain = _plain(word)
        if plain:  # what follows gives the same, only slower
            shape, tail = plain
            code = _shape_code(shape + tail) | LETTERS | len(tail) << OTHERS
            code |= SHORT if len(word) - len(tail) <= 3 else 0
            code |= ENDS if tail == "." else 0
        else:
            code = self.slow(word)
        if len(word) <= 64:
            self[word] = code
        return code

    @staticmethod
    def slow(word: str) -> int:
        letters = [c for c in word if c.isalpha()]
        code = _shape_code(word_shape(word))
        if letters:
            code |= LETTERS
            if _SYMBOL.search(word):
                code |= SYMBOLS
            if len(letters) > 1 and all(c.isupper() for c in letters):
                code |= CAPITALS
            if len(letters) <= 3:
                code |= SHORT
        elif not any(c.isdigit() for c in word):
            code |= BARE
        if word.endswith("!!"):
            code |= SHOUT
        code |= sum(not c.isalnum() for c in word) << OTHERS
        if word[-1] in ".!?:。！？…":
            code |= ENDS
        return code


_codes = _Codes()


def read_words(text: str | None) -> tuple[list[str], np.ndarray]:
    words = (text or "").split()
    if len(_codes) > CODES:
        _codes.clear()
    return words, np.fromiter(map(_codes.__getitem__, words), np.int64, len(words))


def votes(words: list[str], codes: np.ndarray) -> list[int]:
    n = len(words)
    if not n:
        return [NONE] * len(LABELLERS)
    share = lambda bit: np.count_nonzero(codes & bit) / n
    with_letters = max(1, np.count_nonzero(codes & LETTERS))
    facts = {
        "symbols": share(SYMBOLS),
        "bare": share(BARE),
        "capitals": np.count_nonzero(codes & CAPITALS) / with_letters,
        "shout": share(SHOUT),
        "again": sum(map(operator.eq, words, words[1:])) / n,
        "variety": len(set(words)) / n,
        "short": np.count_nonzero(codes & SHORT) / with_letters,
        "ends": share(ENDS),
        "letters": 1 - int((codes >> OTHERS).sum()) / sum(map(len, words)),
    }
    out = []
    for name, junk, fine, sign, least in LABELLERS:
        x = facts[name]
        out.append(NONE if n < least else JUNK if sign * (x - junk) > 0 else FINE if sign * (x - fine) < 0 else NONE)
    return out


#: Fact, the value beyond which it means junk, the value up to which it means fine, the direction, and the
#: words that a text must have for the share to mean something; labellers say nothing of shorter ones.
LABELLERS = [
    ("symbols", 0.25, 0.03, 1, 8),
    ("bare", 0.2, 0.03, 1, 8),
    ("capitals", 0.5, 0.1, 1, 8),
    ("shout", 0.2, 0.01, 1, 8),
    ("again", 0.2, 0.03, 1, 8),
    ("variety", 0.1, 0.2, -1, 50),
    ("short", 0.08, 0.15, -1, 30),
    ("ends", 0.01, 0.03, -1, 60),
    ("letters", 0.75, 0.85, -1, 8),
]


def pattern(text: str | None) -> int:
    code = 0
    for v in votes(*read_words(text)):
        code = 3 * code + v
    return code


def features(codes: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed shapes and of hashed pairs of shapes."""
    out = np.zeros(DIMENSIONS, np.float32)
    shapes = codes & (DIMENSIONS - 1)
    n = len(shapes)
    if n:
        pairs = (shapes[:-1] * 619 + shapes[1:] * 31 + 7) & (DIMENSIONS - 1)
        out += np.bincount(shapes, minlength=DIMENSIONS) / n
        out += np.bincount(pairs, minlength=DIMENSIONS) / n
        np.sqrt(out, out=out)
    return out


@dataclass
class LabelModel:
    """Share of junk and vote tables by labeller: ``tables[j, y, v]`` is P(vote v | class y, voted);
    silence says nothing (its factor is 1), else short texts would make a class of their own."""

    junk_share: float = 0.1
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))
    accuracies: list[float] = field(default_factory=list)

    @staticmethod
    def unpack(patterns: np.ndarray) -> np.ndarray:
        n = len(LABELLERS)
        return (patterns[:, None] // 3 ** np.arange(n - 1, -1, -1)) % 3

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(junk) of patterns."""
        v = self.unpack(np.asarray(patterns, np.int64))
        logs = np.stack([np.log(self.tables[np.arange(v.shape[1]), y, v]).sum(axis=1) for y in (0, 1)])
        logs += np.log([[1 - self.junk_share], [self.junk_share]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
        """Starts from "junk if any labeller says so". One pseudo-count a cell keeps tables proper; on fine texts
        they are as many as ``BELIEF`` says."""
        patterns, counts = np.asarray(patterns, np.int64), np.asarray(counts, float)
        v = cls.unpack(patterns)
        p = np.where((v == JUNK).any(axis=1), 0.9, 0.02)
        out = cls()
        before = -1.0
        for _ in range(rounds):
            weight = np.stack([counts * (1 - p), counts * p])
            out.junk_share = float(min(max((weight[1].sum() + 1) / (counts.sum() + 10), 1e-6), 0.49))
            out.tables = np.ones((v.shape[1], 2, 3))
            for y in (0, 1):
                said = np.stack([(weight[y][:, None] * (v == vote)).sum(axis=0) for vote in (FINE, JUNK)], axis=1)
                # each labeller knows one kind of junk: its alarms are rarely false, its silence means little
                believed = BELIEF * said.sum(axis=1, keepdims=True) * [1 - FALSE_ALARMS, FALSE_ALARMS] if y == 0 else 0
                said = said + 1 + believed
                out.tables[:, y, FINE:] = said / said.sum(axis=1, keepdims=True)
            p = out.posterior(patterns)
            now = float((counts * p).sum())
            if abs(now - before) < 1e-6 * max(1.0, counts.sum()):
                break
            before = now
        out.accuracies = ((1 - out.junk_share) * out.tables[:, 0, FINE] + out.junk_share * out.tables[:, 1, JUNK]).tolist()
        return out


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray
    intercept: float

    def score(self, codes: np.ndarray) -> float:
        n = len(codes)
        odds = n * (features(codes) @ self.weights + self.intercept) + EVIDENCE * np.log(BLANK / (1 - BLANK))
        return float(1 / (1 + np.exp(-np.clip(odds / (n + EVIDENCE), -50, 50))))


def fit_scorer(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    weight = (weight / weight.sum()).astype(np.float32)
    step = 4 / max(1e-6, float((weight[:, None] * x * x).sum()) * 1.0)
    w = np.zeros(x.shape[1], np.float32)
    ahead = w
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -50, 50)))
        g = x.T @ (weight * (p - y)) + ridge * ahead
        new = ahead - step * g
        ahead = new + (t / (t + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([pattern(t.as_py()) for t in b.column(1)], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), found], names=["doc_id", "pattern"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            found = [features(read_words(t.as_py())[1]).tobytes() for t in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), part.column(1)], names=["x", "p"])


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Classifier, DataFrame]:
    """The classifier, and (doc_id, pattern, label) of every document."""
    spark = docs.sparkSession
    rows = _columns(docs, id_col, text_col)
    voted = persist_table(rows.mapInArrow(_patterns, "doc_id long, pattern int"), "quality-votes")
    counted = sorted(voted.groupBy("pattern").count().collect())  # at most 3 ** 9 rows
    patterns, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], float)
    if not len(patterns):
        return Classifier(LabelModel(), np.zeros(DIMENSIONS, np.float32), -1.0), voted.withColumn("label", F.lit(0.0))
    model = LabelModel.fit(patterns, counts)
    p = model.posterior(patterns)
    known = spark.createDataFrame(list(zip(patterns.tolist(), p.tolist(), strict=True)), "pattern int, label double")
    labelled = voted.join(F.broadcast(known), "pattern").select("doc_id", "pattern", "label")
    share = [min(1.0, sample / max(1.0, counts[side].sum())) for side in (p < 0.5, p >= 0.5)]
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < F.when(F.col("label") >= 0.5, share[1]).otherwise(share[0]) * (1 << 30)
    drawn = labelled.where(draw).select("doc_id", "label").dropDuplicates(["doc_id"]).limit(4 * sample)
    chosen = rows.join(F.broadcast(drawn), "doc_id").select("text", "label").limit(4 * sample)
    got = chosen.mapInArrow(_sampled, "x binary, p double").toArrow()
    y = got["p"].to_numpy()
    if not len(y):
        return Classifier(model, np.zeros(DIMENSIONS, np.float32), -1.0), labelled
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), DIMENSIONS)
    order = np.lexsort((*x[:, :8].T, y))  # rows come in any order; sums should not depend on it
    weights, intercept = fit_scorer(x[order], y[order].astype(np.float32), np.ones(len(y), np.float32))
    return Classifier(model, weights, intercept), labelled


def classify(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, label (posterior of the votes), score (of junk), keep of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, float] = {}
        for b in batches:
            n, labels, scores = [], [], []
            for t in b.column(1):
                words, codes = read_words(t.as_py())
                code = 0
                for v in votes(words, codes):
                    code = 3 * code + v
                if code not in cache:
                    cache[code] = float(model.labels.posterior(np.array([code]))[0])
                n.append(len(words))
                labels.append(cache[code])
                scores.append(round(model.score(codes), 4))
            keep = [s < threshold for s in scores]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(labels, pa.float64()), pa.array(scores, pa.float64()), pa.array(keep, pa.bool_())],
                names=["doc_id", "n_words", "label", "score", "keep"],
            )

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, label double, score double, keep boolean")


def keep_good(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model, _ = train(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [round(model.score(read_words(t.as_py())[1]), 4) < threshold for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, _ = train(docs)
    return classify(docs, model)


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
