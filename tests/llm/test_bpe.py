from __future__ import annotations

import hashlib
import random
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

P = pytest.importorskip("public_tokenizers")
TOKENIZERS = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def model():
    return bpe.load_model(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def table(model):
    return bpe.MergeTable.from_json(model)


@pytest.fixture(scope="module")
def library():
    t = TOKENIZERS.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def random_table(rng, letters=b"abc", n=40):
    tokens = {i: bytes([b]) for i, b in enumerate(letters)}
    merges, seen = [], set(tokens.values())
    for _ in range(n * 3):
        a, b = rng.integers(0, len(tokens), 2)
        c = tokens[a] + tokens[b]
        if c in seen or len(c) > 9:
            continue
        seen.add(c)
        merges.append((int(a), int(b), len(tokens)))
        tokens[len(tokens)] = c
        if len(merges) == n:
            break
    return bpe.MergeTable(tokens, merges, {})


@pytest.mark.parametrize("seed", range(25))
def test_transducer_equals_merging_the_whole_word(seed):
    rng = np.random.default_rng(seed)
    table = random_table(rng, n=int(rng.integers(1, 60)))
    for _ in range(8):
        word = bytes(rng.choice(list(b"abc"), int(rng.integers(1, 8 * table.window))).tolist())
        out: list[int] = []
        t = bpe.WordTransducer(table)
        at = 0
        while at < len(word):
            step = int(rng.integers(1, table.window))
            t.push(word[at : at + step], out)
            assert len(t.held) < 2 * table.window
            at += step
        t.close(out)
        assert out == table._merge_long([table.base[b] for b in word])


@pytest.mark.parametrize("seed", range(25))
def test_lookahead_suffices(seed):
    """Tokens that end a lookahead before the end stay whatever follows."""
    rng = np.random.default_rng(100 + seed)
    table = random_table(rng, letters=b"ab", n=int(rng.integers(1, 60)))

    def bounds(word):
        return np.cumsum([len(table.tokens[t]) for t in table._merge_long([table.base[b] for b in word])])

    for _ in range(10):
        head = bytes(rng.choice(list(b"ab"), 3 * table.lookahead).tolist())
        final = len(head) - table.lookahead
        want = [e for e in bounds(head) if e <= final]
        for _ in range(5):
            more = head + bytes(rng.choice(list(b"ab"), int(rng.integers(1, 40))).tolist())
            assert [e for e in bounds(more) if e <= final] == want


def test_short_and_long_merging_agree(model):
    table = bpe.codec(model).table
    for word in (b" internationalisation", "naïveté".encode(), b"aaaaaaaaaaaaaaaa", bytes(range(200, 230))):
        assert table.merge(word) == table._merge_long([table.base[b] for b in word])


TEXTS = [
    "", " ", "\n\n \t x", "it's  we'll I'm 'tis '", "naïve Übung 東京 🙂🙂", "a<|endoftext|>b <|endoftext|", "x" * 9000,
    "12345678901234567890 ½ ² Ⅷ", " " * 5000 + "end", "tail" + "\n" * 70000, "&&&%%%$$$ ###", "\x1c\x1d\x1e\x1f\x85  y",
    "<|endoftext|>" * 3, ("word " * 9000) + "é" * 7000, "'" * 5000 + "s", "é \u0000 z", "_" * 20 + "a_b",
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("piece", [1, 7, 5000])
def test_pieces_equal_the_library(model, library, text, piece):
    if piece == 1 and len(text) > 10000:
        text = text[:6000]
    want = library.encode(text, add_special_tokens=False).ids
    own = bpe.codec(model)
    encoder = bpe.StreamEncoder(own.table)
    out = b"".join([encoder.feed(text[i : i + piece]) for i in range(0, len(text), piece)]) + encoder.finish()
    assert np.frombuffer(out, np.int32).tolist() == want
    assert np.frombuffer(own.encode(text), np.int32).tolist() == want
    assert own.decode(np.array(want, np.int32)) == library.decode(want, skip_special_tokens=False) == text


def test_long_runs_keep_memory_constant(model):
    table = bpe.codec(model).table
    encoder = bpe.StreamEncoder(table)
    for _ in range(50):
        encoder.feed("abcxyz" * 1000)
        assert len(encoder.pending) + len(encoder.tail) < 3 * bpe.LONG_RUN + 6100
        assert len(encoder.inner.held) < 2 * table.window


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.integers(1, 9))
def test_any_text(text, piece):
    model = bpe.load_model(P.path("byte_bpe_50k.json"))
    library = TOKENIZERS.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = library.encode(text, add_special_tokens=False).ids
    encoder = bpe.StreamEncoder(bpe.codec(model).table)
    out = b"".join([encoder.feed(text[i : i + piece]) for i in range(0, len(text), piece)]) + encoder.finish()
    assert np.frombuffer(out, np.int32).tolist() == want


def test_malformed_bytes_decode_like_the_library(model, library):
    ids = [np.frombuffer(bpe.codec(model).encode("東🙂é"), np.int32).tolist()[i:] for i in range(3)]
    ids += [[160, 50256, 241], [247, 247], [], [99999999]]
    for x in ids:
        known = [i for i in x if i <= 50256]
        assert bpe.codec(model).decode(np.array(x, np.int64)) == library.decode(known, skip_special_tokens=False)


def test_all_characters_split_alike(model, library):
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c} {c}1{c}" for c in chars)
    assert np.frombuffer(bpe.codec(model).encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_operator(spark, model, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(900, None, None), (None, "ab", "q"), (0, TEXTS[3], "x"), (0, TEXTS[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(df, model).collect()), key=repr)

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    assert got == sorted((want(i, t) for i, t, _ in rows), key=repr)
    encoded = bpe.encode(df, model, ["doc_id"])
    assert sorted(map(repr, bpe.decode(encoded, model, ["doc_id"]).collect())) == sorted(
        map(repr, bpe.round_trip(df, model, ["doc_id"]).select("doc_id", "decoded").collect())
    )
    with pytest.raises(ValueError):
        bpe.encode(df, model, ["doc_id", "ids"])
    assert bpe.digests(df.limit(0), model).collect() == []


def test_words_merged_side_by_side_are_those_merged_alone(table):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh éü漢🙂 1.'") for _ in range(rng.randint(1, 24))).encode() for _ in range(3_000)] + [b"a", b"the", b"  "]
    assert table.merge_many(words) == [array("i", table.merge(w)).tobytes() for w in words]
    assert table.merge_many([]) == []


def test_frequent_words_outlive_rare_ones(table, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    words = bpe.Words(table)
    merged = []
    monkeypatch.setattr(table, "merge", lambda w, merge=table.merge: (merged.append(w), merge(w))[1])
    for i in range(400):
        assert words[" often"] and words[f" rare{i}"]
    assert merged.count(b" often") == 1 and len(words) <= 50
