"""The pipeline on the smallest table, each stage against plain Python on that stage's own input."""

from collections import Counter

import pytest

import corpus_pipeline
from qaflow.llm import mixing, pii, quality
from qaflow.llm.common import materialize
from tests.llm.test_bpe import REFERENCE
from tests.llm.test_mixing import count
from tests.llm.test_pii import brute as base_spans
from tests.llm.test_quality import brute as counts
from tests.llm.test_simhash import brute_classes, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF), f"test-{name}"))
    return docs


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()


def test_quality(stages):
    kept = rows(stages[1])
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(stages[0]).collect()}
    assert set(kept) == {d for d, k in verdicts.items() if k}
    for d, r in rows(stages[0]).items():
        n, _, _, _, repeated = counts(r["text"])
        if n < 10 or 100 * repeated > 20 * n:
            assert d not in kept


def test_simhash(stages):
    classes = brute_classes({d: brute_fingerprint(r["text"]) for d, r in rows(stages[1]).items()})
    assert set(rows(stages[2])) == set(classes.values())


def test_pii(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after)
    for d, r in before.items():
        spans = base_spans(r["text"])
        if not any(spans):
            assert after[d]["text"] == r["text"]
        for own in spans:
            for s, e in own:
                assert r["text"][s:e] not in after[d]["text"]
        assert after[d]["n_chars"] == len(after[d]["text"])
    assert any("[EMAIL]" in r["text"] for r in after.values()) and pii.KINDS[0] == "email"


def test_mixing(stages):
    rates = {r["source_key"]: r["rate"] for r in mixing.rates(stages[3]).collect()}
    found = Counter(r["doc_id"] for r in stages[4].collect())
    for d, r in rows(stages[3]).items():
        assert found.get(d, 0) == count(d, rates["=" + r["source"]], mixing.MixConfig().seed)


def test_bpe(stages):
    texts = rows(stages[4])
    out = stages[5].collect()
    assert len(out) == stages[4].count() and "text" not in stages[5].columns
    assert all(list(r["token_ids"]) == REFERENCE.encode_ordinary(texts[r["doc_id"]]["text"]) for r in out)


def test_run(spark, stages):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, out.collect())) == sorted(map(str, stages[5].collect()))
