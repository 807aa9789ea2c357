from __future__ import annotations

import hashlib
import random

import pytest

from stoneloom.llm import bpe_stream as op

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(op.default_vocabulary())


def same(library, text):
    c = op.codec(op.default_vocabulary())
    want = library.encode(text, add_special_tokens=False).ids
    got = list(c.encode(text))
    assert got == want, text[:100]
    decoded = library.decode(want, skip_special_tokens=False)
    assert "".join(c.decode(got)) == decoded
    digest = hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
    assert c.digest(text) == (len(want), *digest)


TEXTS = [
    "", " ", "a", "Don't we'll I'D", "</w>a </w>", "x<|endoftext|><|startoftext|>Y<|ENDOFTEXT|>", "ΟΔΟΣ Σας İı ǅ", "é é ẛ̣",
    "中文字 한국어 ١٢٣ ½ ²", "👩‍👩‍👧 🏳️‍🌈", "a\x00b\x1c\x1d\x85\xa0 c", "!!!???...---", "1234567", "a" * 3000, "ab" * 2000, "the" * 1500, "�￿",
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts(library, text):
    same(library, text)


def test_random_texts(library):
    r = random.Random(5)
    words = [w.removesuffix("</w>") for w in library.get_vocab() if w.isascii() and w.removesuffix("</w>").isalpha()]
    alphabet = "etaoinshrdlu" * 6 + "zqxjkv'’.,!?-0123456789 \n\té中ΣÅ🙂̧"
    for i in range(300):
        same(library, "".join(r.choice(alphabet) for _ in range(r.choice([3, 30, 300]))))
        same(library, "".join(r.choice(words) for _ in range(r.choice([2, 12, 60]))))


def test_long_words_stream_with_a_bounded_window(library):
    merges = op.codec(op.default_vocabulary()).merges
    r = random.Random(6)
    taken = 0

    def symbols():
        nonlocal taken
        for _ in range(5000):
            taken += 1
            yield r.choice("aeinorst")

    behind, emitted = 0, 0
    for token in merges.stream(symbols()):
        behind = max(behind, taken - emitted)
        emitted += len(token)
    assert emitted == 5000 and behind < 20 * merges.lookahead


def test_lookahead_is_the_longest_token(library):
    merges = op.codec(op.default_vocabulary()).merges
    assert merges.lookahead == max(len(t.removesuffix("</w>")) for t in library.get_vocab() if not t.startswith("<|"))


def test_bytes_come_out_when_complete(tmp_path):
    import json

    from stoneloom.llm.packing import default_vocabulary

    spec = json.load(open(default_vocabulary(), encoding="utf-8"))
    assert spec["decoder"]["type"] == "ByteLevel"
    c = op.Codec(default_vocabulary())
    ids = tokenizers.Tokenizer.from_file(default_vocabulary()).encode("né 中 🙂 x", add_special_tokens=False).ids
    pieces = list(c.decode(ids))
    assert "".join(pieces) == "né 中 🙂 x" and all("�" not in p for p in pieces)
    raw = [bytes(c.byte[x] for x in c.token[i]) for i in ids]
    for k in range(len(ids)):  # some of these end inside a character
        assert "".join(c.decode(ids[:k])) == b"".join(raw[:k]).decode("utf-8", "replace")


def test_every_word_goes_through_the_transducer(library, monkeypatch):
    c = op.Codec(op.default_vocabulary())
    streamed = []
    stream = c.merges.stream
    monkeypatch.setattr(c.merges, "stream", lambda symbols: streamed.append(len(symbols)) or stream(symbols))
    monkeypatch.setattr(c.merges, "merged", None)  # no other way is left
    text = "The transducer takes every word, short or " + "very" * 200 + " long, once; the same word again is known."
    assert list(c.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert len(streamed) == len(set(c.words(text))) and max(streamed) == 800 and min(streamed) == 1


def test_neighbours_against_merging(library):
    """The test at the border of two tokens gives what the merge list makes of them."""
    merges = op.codec(op.default_vocabulary()).merges
    assert merges.plain
    r = random.Random(8)
    tokens = sorted(t for t in merges.tokens if merges.merged(merges.split(t)) == [t])
    starts = [t for t in tokens if op.END not in t]
    short = [t for t in starts if len(t) < 4]
    for a, b in [*((r.choice(starts), r.choice(tokens)) for _ in range(4000)), *((r.choice(short), r.choice(short)) for _ in range(4000))]:
        assert merges._apart(a, b) == (merges.merged(merges.split(a) + merges.split(b)) == [a, b]), (a, b)
    joined = [(a[: len(a) - n], a[len(a) - n :]) for a in starts[:4000] for n in (1, 2) if len(a) > 3]
    for a, b in joined:
        if a in merges.tokens and b in merges.tokens and merges.merged(merges.split(a)) == [a] and merges.merged(merges.split(b)) == [b]:
            assert merges._apart(a, b) == (merges.merged(merges.split(a) + merges.split(b)) == [a, b]), (a, b)


def test_merge_lists_of_another_kind():
    """Two ways to one token, and a part younger than the whole: then the merge list itself is the test."""
    symbols = {c: i for i, c in enumerate("abcd")}
    for pairs in ([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc"), ("abc", "d")], [("ab", "c"), ("a", "b"), ("c", "d"), ("ab", "cd")]):
        vocab = symbols | {a + b: 10 + i for i, (a, b) in enumerate(pairs)}
        merges = op.MergeList(vocab, pairs, None)
        assert not merges.plain
        r = random.Random(9)
        for _ in range(500):
            word = [r.choice("abcd") for _ in range(r.randint(1, 30))]
            assert list(merges.stream(word)) == merges.merged(word)


def test_megabytes_of_short_words_and_blocks(library, monkeypatch):
    text = "some short words, é and 中文 \n ́x " * 40_000
    same(library, text)
    monkeypatch.setattr(op, "BLOCK", 7)
    for part in (text[:3000], " \n\n" * 50, "x" * 100 + " y", "don't  <|endoftext|> we'll " * 5):
        same(library, part)


def test_operator(spark, rows):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (1, None), (2, "a"), (2, "a")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, n_tokens string")
    t = tokenizers.Tokenizer.from_file(op.default_vocabulary())
    want = []
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]
        want.append((i, len(ids), *sha))
    assert rows(op.round_trip_digests(df)) == sorted(want, key=repr)
    back = op.decode_documents(op.encode_documents(df))
    assert rows(back)[0] == (0, "")
    assert op.round_trip_digests(df.limit(0)).count() == 0
