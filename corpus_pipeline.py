"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and read again as the next stage's ``docs``. All stages but the last return the columns of
``documents``; further columns pass through whatever their names, but for one named ``token_ids``, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qaflow.llm import bpe, mixing, pii, quality, simhash
from qaflow.llm.common import delete_table, temporary_tables, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts fail the base rules and go; very long ones are measured whole; repeated rows are judged alike;
    null languages and sources form groups of their own; an empty table stays empty.
    """
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the least doc_id (null last).

    Null and empty texts are one class; rows repeated with the same doc_id and text stay once; texts of any length are
    fingerprinted whole; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked, and ``n_chars`` follows.

    Rows neither come nor go: null and empty texts stay as they are, very long ones are masked whole, repeated rows alike.
    """
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their sources' rates and shuffled.

    A null source is one of its own; rows that share source and doc_id (null ones too) share a count; texts are not looked
    at; an empty table stays empty.
    """
    return mixing.mix(docs, label=False)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids: the documents' columns without the text, and ``token_ids``.

    Null and empty texts give no ids; very long ones are encoded whole; repeated rows stay; an empty table stays empty.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("quality", quality_stage),
    ("simhash", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

#: SQL has neither XXH64 fingerprints nor the trained stages; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again. Tables go when the next stage is written."""
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporary_tables(spark):
            docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if earlier:
            delete_table(spark, earlier)
        earlier = path
    return STAGES[-1][1](spark, docs, sf_dir)
