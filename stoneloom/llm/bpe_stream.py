"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A sequence of tokens is the merge list's encoding of its text exactly if every two neighbours
are the encoding of their own text. So for every prefix of a word there is one last token that
fits the encoding of the prefix before it, and these prefixes form a tree. A later token can
start at one of the last ``lookahead`` positions only, ``lookahead`` being the length in symbols
of the longest token the merge list can build; what the tree's paths from all these positions
share is stable, is emitted and forgotten. Memory is that window and the table of neighbour
tests, both bounded by constants of the merge list, however long the word. Every word goes this way;
what it gave is remembered for words met again.

Two tokens are neighbours unless the merge list joins across their border: the merges of both are
taken back, the latest first, and at every step the pair at the border must have no merge that is
due before what has been taken back. This needs a token's parts to be older than itself and to be
its only parts; other merge lists are tested by merging.

Texts pass in blocks of about ``BLOCK`` characters that end at a blank, which no word spans, and
blocks as words of the vocabulary's own rules: special tokens, canonical composition, lower
case, letters, single digits and runs of other characters. Blocks with characters up to U+0557 are
handled here; others use the library's Unicode tables for these rules, as the tables of
Python differ from them for some characters.

Decoding is a state machine that takes the stream of ids: blanks between tokens where the file names no
decoder (as the library does), else bytes through a UTF-8 machine that holds at most three bytes back.

Defined results: a null text is empty, with no tokens; equal rows are encoded each; a null id
stays null; other columns play no part.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import table

#: Stands for the end-of-word suffix inside symbols, so that it can't be confused with text.
END = "￿"
CACHE = 1 << 19
BLOCK = 1 << 18
BLANK = regex.compile(r"[ \t\n\r]")
PLAIN = regex.compile(r"[\x00-՗]*+")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> list[str]:
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeList:
    """The merge list of one vocabulary file, with its lookahead and its transducer."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.suffix = suffix or ""

        def own(token: str) -> str:
            return token[: -len(suffix)] + END if suffix and len(token) > len(suffix) and token.endswith(suffix) else token

        self.ids = {own(t): i for t, i in vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {(own(a), own(b)): i for i, (a, b) in enumerate(pairs)}
        self.fits: dict[tuple[str, str], bool] = {}
        #: Rank and parts of every token that is merged; ranks of symbols are below all.
        self.made = {a + b: (i, a, b) for i, ((a, b), _) in reversed(list(enumerate(self.rank.items())))}
        self.plain = len(self.made) == len(self.rank) and all(
            self.made.get(x, (-1,))[0] < i for (a, b), i in self.rank.items() for x in (a, b)
        )
        #: Tokens that are the encoding of their own text.
        self.tokens = {t for t in self.ids if len(self.split(t)) == 1} | {t for t in self.made if t in self.ids and self._alone(t)}
        #: In symbols; the mark is no symbol of its own.
        self.lookahead = max((len(own(a)) + len(own(b)) - own(b).endswith(END) for a, b in pairs), default=1)

    def _alone(self, token: str) -> bool:
        if not self.plain:
            return self.merged(self.split(token)) == [token]
        due, a, b = self.made[token]
        return self._apart(a, b, due) and all(x not in self.made or self._alone(x) for x in (a, b))

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge list applied to the whole of ``symbols``."""
        rank, none = self.rank.get, len(self.rank)
        symbols = symbols[:]
        ranks = [rank(pair, none) for pair in itertools.pairwise(symbols)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            new = symbols[at] + symbols[at + 1]
            symbols[at : at + 2] = [new]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((symbols[at - 1], new), none)
            if at < len(ranks):
                ranks[at] = rank((new, symbols[at + 1]), none)
        return symbols

    @staticmethod
    def split(token: str) -> list[str]:
        symbols = list(token)
        if len(symbols) > 1 and symbols[-1] == END:
            symbols[-2:] = [symbols[-2] + END]
        return symbols

    def neighbours(self, a: str, b: str) -> bool:
        """Whether a, b is the encoding of its own text."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            test = self._apart if self.plain else lambda a, b: self.merged(self.split(a) + self.split(b)) == [a, b]
            found = self.fits[a, b] = test(a, b)
        return found

    def _apart(self, a: str, b: str, due: int | None = None) -> bool:
        """``due``: merges before it come before what has been taken back."""
        rank, made, symbol = self.rank.get, self.made.get, (-1, "", "")
        none = len(self.rank)
        due = none if due is None else due
        while True:
            if rank((a, b), none) < due:
                return False
            of_a, of_b = made(a, symbol), made(b, symbol)
            if of_a[0] > of_b[0]:
                due, a = of_a[0], of_a[2]
            elif of_b[0] < 0:
                return True
            else:  # of merges of one rank the one further left comes first: that at the border
                due, b = of_b[0] + 1, of_b[1]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, each as soon as it is stable."""
        window = ""  # symbols that have not been emitted; only the last of a word has two characters
        last: list[str | None] = []  # last token of the prefix that ends there
        fixed = ""  # the token before the window
        tokens, fits = self.tokens, self.fits
        for symbol in symbols:
            window += symbol
            last.append(None)
            n = len(last)
            # one token fits; a longer one is the likelier
            for start in range(max(0, n - self.lookahead), n):
                text = window[start:]
                if text in tokens:
                    before = last[start - 1] if start else fixed
                    if before is not None:
                        fit = not before or fits.get((before, text))
                        if fit is None:
                            fit = self.neighbours(before, text)
                        if fit:
                            last[-1] = text
                            break
            if n >= 2 * self.lookahead:
                stable = self._stable(last)
                if stable:
                    path = self._path(last, stable)
                    yield from path
                    fixed = path[-1]
                    window = window[stable:]
                    del last[:stable]
        if last:
            yield from self._path(last, len(last))

    def _length(self, token: str) -> int:
        return len(token) - (len(token) > 1 and token.endswith(END))

    def _path(self, last: list[str], end: int) -> list[str]:
        out = []
        while end:
            out.append(last[end - 1])
            end -= self._length(last[end - 1])
        return out[::-1]

    def _stable(self, last: list[str]) -> int:
        """The furthest position that the paths from all of the last ``lookahead`` positions share."""
        live = {i for i in range(len(last) - self.lookahead + 1, len(last) + 1) if last[i - 1] is not None}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - self._length(last[top - 1]))
        return live.pop() if live else 0

    def encode_word(self, symbols: list[str]) -> list[str]:
        if not symbols:
            return []
        if self.suffix:
            symbols[-1] += END
        return list(self.stream(symbols))


class _Known(dict):
    """Ids of words met before; words of up to 64 characters are remembered."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> list[int]:
        ids = self.codec.word_ids(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class Decoder:
    """Ids to text, as they come: ``feed`` gives what has become known, ``end`` the rest."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.begun = False
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.codec.byte_level:
            return self.bytes.decode(b"".join(map(self.codec.raw.__getitem__, ids)))
        lead = " " if self.begun else ""
        self.begun = True
        return lead + " ".join(map(self.codec.token.__getitem__, ids))

    def end(self) -> str:
        return self.bytes.decode(b"", True)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = MergeList(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.characters = _byte_characters()
        self.byte = {c: i for i, c in enumerate(self.characters)}
        self.cuts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.decimal = {i: str(i) for i in self.token}
        self.known = _Known(self)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        return t.normalizer, t.pre_tokenizer

    @functools.cached_property
    def raw(self) -> dict[int, bytes]:
        special = set(self.special.values())
        return {i: t.encode() if i in special else bytes(self.byte[c] for c in t) for i, t in self.token.items()}

    def words(self, text: str) -> list[str]:
        """Words of a block without special tokens."""
        if PLAIN.fullmatch(text):
            text = unicodedata.normalize("NFC", text)
            if PLAIN.fullmatch(text):
                # the library lowers character by character, without the final form of sigma
                text = text.replace("Σ", "σ").lower()
                return WORD.findall(text)
        normalizer, pre = self.library
        text = normalizer.normalize_str(text)
        return [bytes(self.byte[c] for c in w).decode() for w, _ in pre.pre_tokenize_str(text)]

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of a text in order, and whether each is a special token."""
        at = 0
        if self.cuts:
            for m in self.cuts.finditer(text):
                yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        yield text[at:], False

    def word_ids(self, word: str) -> list[int]:
        symbols = [self.characters[b] for b in word.encode()]
        ids = self.merges.ids
        return [ids[t] for t in self.merges.encode_word(symbols)]

    def blocks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > BLOCK:
            blank = BLANK.search(text, at + BLOCK)
            end = blank.start() if blank else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def id_blocks(self, text: str | None) -> Iterator[list[int]]:
        """Ids of a text, block by block."""
        for part, special in self.segments(text or ""):
            if special:
                yield [self.special[part]]
                continue
            for block in self.blocks(part):
                if len(self.known) >= CACHE:
                    self.known.clear()
                yield list(itertools.chain.from_iterable(map(self.known.__getitem__, self.words(block))))

    def encode(self, text: str | None) -> Iterator[int]:
        return itertools.chain.from_iterable(self.id_blocks(text))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text, as soon as they are known."""
        state = Decoder(self)
        for i in ids:
            piece = state.feed([i])
            if piece:
                yield piece
        piece = state.end()
        if piece:
            yield piece

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, digest of the ids and of the decoded text."""
        encoded, decoded, state = hashlib.sha256(), hashlib.sha256(), Decoder(self)
        n = 0
        for ids in self.id_blocks(text):
            if ids:
                encoded.update(((" " if n else "") + " ".join(map(self.decimal.__getitem__, ids))).encode())
                decoded.update(state.feed(ids).encode())
                n += len(ids)
        decoded.update(state.end().encode())
        return n, encoded.hexdigest(), decoded.hexdigest()


@functools.lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids = [list(codec(path).encode(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text of rows with ids."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["".join(codec(path).decode(ids or [])) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    ship_package(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, no ids kept."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [codec(path).digest(t.as_py()) for t in b.column(1)]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bpe_stream": op6_bpe_stream}
ORACLES: dict[str, str] = {}
