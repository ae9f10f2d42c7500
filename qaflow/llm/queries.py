"""The registered queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaflow.llm import audit, bpe, langid, media, mixing, paragraphs, phrases, pieces, pii, quality, sharding, simhash, warc
from qaflow.llm.oracles import ORACLE_SQL  # noqa: F401  registered beside the queries


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_documents(spark, sf_dir), *_ranks())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op5_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_texts(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_documents(spark, sf_dir)).select("doc_id", "source", "slot", "shard", "shard_name")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.withColumn("headers", lines)


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(_documents(spark, sf_dir))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digest_documents(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_interleaved": op5_interleaved,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_warc": op9_warc,
    "op10_paragraphs": op10_paragraphs,
    "op11_pieces": op11_pieces,
    "op12_audit": op12_audit,
    "op13_phrases": op13_phrases,
}
