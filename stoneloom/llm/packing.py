"""Packing of documents into windows of fixed size by sum-of-squares online packing.

Every task packs the documents of its own partition in order; nothing is shuffled. A document
is its token ids and one end id. Whole windows are cut off its front; the rest, shorter than a
window, is placed by the fill levels of the open windows. ``Levels.counts[c]`` is the number of open
windows filled to between c and c + 1 granules of ``GRANULE`` ids; a piece goes where the sum of the
squares of these counts becomes the least:

* whole onto an open window, which moves from level c to level d: 2 * (counts[d] - counts[c]) + 2, or 0 on the same level;
* onto a window that it fills, its overhang of less than a granule cut off and placed in turn: 1 - 2 * counts[c];
* onto a window that it fills with a longer overhang, which is placed in turn: as much, and ``CUT`` for the cut;
* into a new window at level c: 2 * counts[c] + 1.

Ties go to the fuller window. Levels in granules let windows fill up to the last id: a piece need
not match a gap exactly. The cost of new windows grows with their level's count, that of a cut does
not, so a level holds a handful of windows and memory is bounded. Windows that are open at the end
of the partition are completed in order, the fullest first, from the pieces of the emptiest; at most one
window of a partition is padded. A window's number is the partition's number
in the upper bits and a count in the lower 32, so a task that runs again numbers alike.

The ids are those of the tokenizers library for the given file: the file's vocabulary is in
merge order, so its ids are the ranks that tiktoken merges by; special tokens in a text become
their own ids, as the library has it.

Defined results: a null text is empty and so is the end id alone; a null id stays null; equal
rows are packed each; other columns play no part. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import table

WINDOW = 1024
END = 0
#: Ids of a fill level; squares that a cut with a longer overhang must save.
GRANULE, CUT = 64, 16
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def encoder(path: str) -> tuple[tiktoken.Encoding, tuple[str, ...]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


@functools.lru_cache(4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, path: str) -> np.ndarray:
    coder, special = encoder(path)
    if len(text) > 1 << 18:  # the library's matcher needs no stack for very long runs of blanks
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    if any(s in text for s in special):
        return np.array(coder.encode(text, allowed_special="all"), np.uint32)
    return np.array(coder.encode_ordinary(text), np.uint32)


class Levels:
    """Open windows by fill level. A piece is (row, start, ids)."""

    def __init__(self, window: int, granule: int = GRANULE):
        self.window, self.granule = window, granule
        n = -(-window // granule)
        self.counts = [0] * n
        self.open: list[list[tuple[int, list[tuple]]]] = [[] for _ in range(n)]  # (fill, pieces)

    @property
    def n_open(self) -> int:
        return sum(self.counts)

    def _add(self, fill: int, pieces: list[tuple]) -> None:
        self.open[fill // self.granule].append((fill, pieces))
        self.counts[fill // self.granule] += 1

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        """Places a piece shorter than a window; gives the pieces of every window that becomes full."""
        counts, w, g = self.counts, self.window, self.granule
        while True:
            row, start, ids = piece
            size = len(ids)
            best, at = 2 * counts[size // g] + 1, -1
            for c, n in enumerate(counts):
                if n:
                    total = self.open[c][-1][0] + size
                    if total < w:
                        d = total // g
                        cost = 0 if d == c else 2 * (counts[d] - n) + 2
                    else:
                        cost = 1 - 2 * n + (CUT if total - w >= g else 0)
                    if cost <= best:  # the fuller one among equals
                        best, at = cost, c
            if at < 0:
                self._add(size, [piece])
                return
            fill, pieces = self.open[at].pop()
            counts[at] -= 1
            if fill + size < w:
                self._add(fill + size, [*pieces, piece])
                return
            room = w - fill
            yield [*pieces, (row, start, ids[:room])]
            if room == size:
                return
            piece = (row, start + room, ids[room:])

    def finish(self) -> Iterator[list[tuple]]:
        """Completes the open windows, the fullest first, from the emptiest; the last may be short."""
        left = sorted((x for level in self.open for x in level), key=lambda x: x[0])
        self.__init__(self.window, self.granule)
        rest: list[tuple] = []  # pieces taken from the emptiest windows
        while left:
            fill, pieces = left.pop()
            room = self.window - fill
            while room and (rest or left):
                if not rest:
                    rest = left.pop(0)[1][::-1]
                row, start, ids = rest.pop()
                pieces = [*pieces, (row, start, ids[:room])]
                if len(ids) > room:
                    rest.append((row, start + room, ids[room:]))
                room -= min(room, len(ids))
            yield pieces
        if rest:
            yield rest[::-1]


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def packer(path: str, window: int = WINDOW, end: int = END, flush_bytes: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        levels, number = Levels(window), 0
        out: list[tuple] = []
        held = 0

        def emit(pieces: list[tuple]) -> None:
            nonlocal number, held
            offset = 0
            for (doc, tokens), start, ids in pieces:
                out.append((doc, start, ids.tobytes(), tokens, first + number, offset))
                offset += len(ids)
            held += 4 * offset
            number += 1

        def batch() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out, strict=True))
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", path), np.uint32(end)).astype("<u4")
                row = (doc, len(ids))
                whole = len(ids) - len(ids) % window
                for at in range(0, whole, window):
                    emit([(row, at, ids[at : at + window])])
                if whole < len(ids):
                    for full in levels.place((row, whole, ids[whole:].copy())):
                        emit(full)
                if held >= flush_bytes:
                    yield batch()
        for pieces in levels.finish():
            emit(pieces)
        if out:
            yield batch()

    return run


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. A sequence is its pieces by offset, padded to ``window``."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(packer(vocabulary or default_vocabulary(), window), schema)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
