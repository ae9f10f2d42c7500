"""Every operator and pipeline stage on awkward documents and on an empty table."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qaflow.llm import bpe, langid, media, mixing, paragraphs, pieces, pii, quality, sharding, simhash, warc
from tests.llm.cases import documents, empty, rows

EMPTY = hashlib.sha256(b"").hexdigest()
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")

#: name: (operator, whether it returns one row for each input row)
OPERATORS = {
    "langid": (langid.identify, True),
    "pii": (pii.detect, True),
    "redact": (pii.redact, True),
    "bpe": (lambda d: bpe.digest_documents(d, RANKS, P.PATTERN), True),
    "encode": (lambda d: bpe.encode_documents(d, RANKS, P.PATTERN), True),
    "pieces": (lambda d: pieces.digest_documents(d, PIECES), True),
    "encode_pieces": (lambda d: pieces.encode_documents(d, PIECES), True),
    "simhash": (simhash.near_duplicates, True),
    "keep_one": (simhash.keep_one, False),
    "media": (media.digest_texts, True),
    "quality": (quality.judge, True),
    "keep_good": (quality.keep_good, False),
    "mixing": (mixing.mix, False),
    "sharding": (sharding.place, True),
    "paragraphs": (paragraphs.repeated, False),
    "remove": (paragraphs.remove, True),
    "warc": (lambda d: warc.resolve_revisits(warc.records_of_pages(d.selectExpr("doc_id AS page_id", "text AS url", "text AS html", "row"))), False),
}

#: What a null and an empty text give, by column; None stands for a row that goes.
DEFINED = {
    "langid": {"lang_pred": "und", "score": 0.0},
    "pii": {"n_email": 0, "n_ip": 0, "n_card": 0, "n_phone": 0, "spans": "", "n_added": 0, "n_spans": 0},
    "bpe": {"n_tokens": 0, "ids_sha256": EMPTY, "decoded_sha256": EMPTY},
    "encode": {"token_ids": []},
    "pieces": {"n_tokens": 0, "ids_sha256": EMPTY, "decoded_sha256": EMPTY},
    "encode_pieces": {"piece_ids": []},
    "simhash": {"fingerprint": "0" * 16, "component_id": 0},
    "media": {"n_bytes": 0, "payload_bytes": 64, "payload_sha256": hashlib.sha256(bytes(64)).hexdigest()},
    "quality": {"n_words": 0, "base_failed": True, "kept": False},
    "keep_good": None,
}


@pytest.mark.parametrize("name", DEFINED)
def test_null_and_empty_texts(spark, name):
    """Rows 0 (null) and 1 (empty) of the awkward documents, and all null rows."""
    found = [r for r in OPERATORS[name][0](documents(spark)).collect() if r["doc_id"] in (0, 1)]
    if DEFINED[name] is None:
        assert not found
        return
    assert len(found) == 2
    for r in found:
        assert {k: r[k] for k in DEFINED[name]} == DEFINED[name]


def test_repeated_rows_have_equal_results(spark):
    """Rows 5, 6 and the copy of 5 hold one text, long enough for every operator."""
    for name in ("langid", "pii", "bpe", "simhash", "media", "quality", "redact", "sharding"):
        found = [{k: v for k, v in r.asDict(True).items() if k not in ("doc_id", "row", "lang", "source", "held_out")} for r in OPERATORS[name][0](documents(spark)).collect() if r["doc_id"] == 5]
        assert len(found) == 2 and found[0] == found[1], name
    kept = [r["doc_id"] for r in OPERATORS["keep_one"][0](documents(spark)).collect()]
    assert kept.count(5) == 1 and 6 not in kept
    cut = {r["doc_id"]: r["text"] for r in OPERATORS["remove"][0](documents(spark)).collect()}
    assert cut[6] == "" and cut[5] == dict((r[0], r[1]) for r in rows())[5]


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    operator, whole = OPERATORS[name]
    found = operator(documents(spark)).collect()
    if whole:
        assert len(found) == len(rows())
        assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == sorted(r[0] for r in rows() if r[0] is not None)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name][0](empty(spark)).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_columns(spark, name, stage):
    docs = documents(spark)
    out = stage(spark, docs, "/nowhere")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.schema.simpleString() == docs.schema.simpleString()
    assert stage(spark, empty(spark), "/nowhere").count() == 0
    assert out.count() >= 0


def test_all_null_columns(spark):
    docs = documents(spark).select(*[F.lit(None).cast(t).alias(c) for c, t in documents(spark).dtypes])
    for name, (operator, whole) in OPERATORS.items():
        n = operator(docs).count()
        assert n == len(rows()) if whole else n >= 0, name


def test_a_text_longer_than_a_block(spark):
    """A text of five million bytes between short ones: encoders take blocks of rows of up to four, hashes of ranges keep a million powers."""
    import sentencepiece

    long = ("green water " * 9 + "stone\n") * 45_000
    docs = spark.createDataFrame([(1, "before"), (2, long), (3, "after it"), (4, long[:300] + " x")], "doc_id long, text string").coalesce(1)
    for name in ("bpe", "pieces"):
        found = {r["doc_id"]: r for r in OPERATORS[name][0](docs).collect()}
        assert found[2]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
        assert found[3]["decoded_sha256"] == hashlib.sha256(b"after it").hexdigest()
    assert found[2]["n_tokens"] == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(long))
    cut = paragraphs.Cut(long.encode(), paragraphs.ParagraphConfig())
    start = paragraphs.Cut(long[: 109 * 40].encode(), paragraphs.ParagraphConfig())
    same = min(cut.lines, start.lines) - 1
    assert cut.ids()[:same].tolist() == start.ids()[:same].tolist()
