import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from qaflow.llm import bpe
from tests.llm.cases import documents, rows

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, P.PATTERN, cache_size=50)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_equals_library_and_round_trips(text):
    ids = ENCODER.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert ENCODER.decode(ids).decode() == text


def test_very_long_pretokens():
    rng = random.Random(3)
    for text in ("a" * 20_000, " " * 20_000, "".join(rng.choice("abcdet") for _ in range(20_000))):
        assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)
    assert not any(ENCODER.low) and not any(ENCODER.mid)  # the queue ends empty


def test_digests(spark):
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    for r in bpe.digest_documents(documents(spark), PATH, P.PATTERN).where("doc_id IS NOT NULL").collect():
        ids = REFERENCE.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encoded_column(spark):
    out = bpe.encode_documents(documents(spark), PATH, P.PATTERN).where("doc_id = 12").first()
    assert list(out["token_ids"]) == REFERENCE.encode_ordinary(rows()[12][1])
