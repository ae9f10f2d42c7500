import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from qaflow.llm import pieces
from tests.llm.cases import documents, empty, rows

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = pieces.Encoder(PATH, cache_size=50)
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz  ", "aeioutnsr \n", "▁ a\t", "日本語テスト漢 ab", "éàüßñœ ", "0123456789 .,", "😀‍ x", "\x00\x01\x85\xa0  ", "def()[]{}=_\n    "]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_equals_library_and_its_decode(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode(text)
    assert ENCODER.decode(ids) == LIBRARY.decode(ids)


def test_mixed_alphabets():
    rng = random.Random(2)
    for _ in range(1500):
        letters = rng.choice(ALPHABETS) + rng.choice(ALPHABETS)
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(80)))
        assert ENCODER.encode(text) == LIBRARY.encode(text), text


@given(st.lists(st.integers(0, 31_999), max_size=12))
@settings(max_examples=300, deadline=None)
def test_any_ids_decode_as_by_library(ids):
    assert ENCODER.decode(ids) == LIBRARY.decode(ids)


@given(st.lists(st.integers(1, 260), max_size=12))
@settings(max_examples=300, deadline=None)
def test_broken_bytes_decode_as_by_library(ids):
    assert ENCODER.decode(ids) == LIBRARY.decode(ids)


def test_very_long_words_and_texts():
    rng = random.Random(3)
    pool = [rows()[8][1], "日本語" * 400, "the of a "]
    for text in (
        "a" * 20_000, " " * 20_001, "ab" * 10_000, "x" * 1024, "x" * 1025, "".join(rng.choice("abcdet") for _ in range(20_000)),
        "".join(rng.choice(pool) for _ in range(400)),
    ):
        assert ENCODER.encode(text) == LIBRARY.encode(text)


def test_one_word_by_every_way():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abcdetin▁") for _ in range(rng.randrange(1, 40)))
        symbols = ENCODER.tables.symbol_of[np.frombuffer(word.encode("utf-32-le"), "<u4")]
        expected = [x.tolist() for x in pieces.merge_one(ENCODER.tables, symbols)]
        assert [x.tolist() for x in pieces.merge_long(ENCODER.tables, symbols)] == expected
        assert [x.tolist() for x in pieces.merge_rounds(ENCODER.tables, symbols.copy(), np.zeros(1, np.int64))] == expected


def test_words_that_share_a_hash_are_told_apart():
    encoder = pieces.Encoder(PATH)
    encoder.noise[:] = 1  # now all words of a length share a hash
    text = "one two six ten old new"
    assert encoder.encode(text) == LIBRARY.encode(text)


def test_small_store():
    encoder = pieces.Encoder(PATH, cache_size=3)
    for _ in range(3):
        for text in ("some words here", "and other words", None, ""):
            assert encoder.encode(text) == (LIBRARY.encode(text) if text else [])
    found, bounds = encoder.encode_batch(["a b", None, "", "c"])
    assert [found[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == [LIBRARY.encode("a b"), [], [], LIBRARY.encode("c")]


def test_other_kinds_of_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Tables(pieces.Model(b""))


def test_digests(spark):
    expected = []
    for doc_id, text, *_ in rows():
        ids = LIBRARY.encode(text) if text else []
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))]
        expected.append((doc_id, len(ids), *digests))
    assert sorted(map(tuple, pieces.digest_documents(documents(spark), PATH).collect()), key=repr) == sorted(expected, key=repr)
    assert pieces.digest_documents(empty(spark), PATH).count() == 0


def test_encoded_and_decoded_columns(spark):
    out = pieces.decode_documents(pieces.encode_documents(documents(spark), PATH), PATH)
    assert out.columns == [*documents(spark).columns, "piece_ids", "decoded"]
    for r in out.collect():
        assert list(r["piece_ids"]) == (LIBRARY.encode(r["text"]) if r["text"] else [])
        assert r["decoded"] == (r["text"] or "")
    again = pieces.encode_documents(out.withColumnRenamed("decoded", "row_"), PATH)  # the column of ids is replaced
    assert again.columns[-1] == "piece_ids" and again.count() == len(rows())
