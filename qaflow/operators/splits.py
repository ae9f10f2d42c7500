"""Cleaning, classification and exact stratified splits of grounded question-answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.functions.strings import IDK, NO_CONTEXT, canonical_answer, strip, to_bool
from qaflow.operators.sampling import split_exact
from qaflow.schemas import require_columns


def example_class(context: Column, answer: Column, negative: Column, idk: str = IDK, no_context: str = NO_CONTEXT) -> Column:
    """refusal without context or with the no-context answer; then negative; then refusal for the IDK answer; else correct."""
    return (
        F.when((strip(context) == "") | (answer == no_context), "refusal")
        .when(negative, "negative")
        .when(answer == idk, "refusal")
        .otherwise("correct")
    )


def classified(df: DataFrame, idk: str = IDK, no_context: str = NO_CONTEXT, extra_idk: tuple = ()) -> DataFrame:
    """Clean, canonicalise and classify every row; ``keep`` says whether query and answer are non-empty."""
    require_columns(df, ["query", "context", "answer", "negative"])
    clean = df.withColumns(
        {
            "query": strip(F.col("query")),
            "context": strip(F.col("context")),
            "answer": canonical_answer(F.col("answer"), idk, no_context, extra_idk),
            "negative": to_bool(F.col("negative"), df.schema["negative"].dataType.simpleString()),
        }
    )
    return clean.withColumn("example_type", example_class(F.col("context"), F.col("answer"), F.col("negative"), idk, no_context)).withColumn(
        "keep", (F.col("query") != "") & (F.col("answer") != "")
    )


def split_rows(df: DataFrame, **texts) -> DataFrame:
    return classified(df, **texts).where("keep").drop("keep")


def class_counts(df: DataFrame) -> DataFrame:
    """seen, kept and dropped rows of each class."""
    kept = F.col("keep").cast("int")
    return classified(df).groupBy("example_type").agg(F.count("*").alias("seen"), F.sum(kept).alias("kept"), F.sum(1 - kept).alias("dropped"))


def stratified(df: DataFrame, keys: list[str], per_class: int, seed: int) -> DataFrame:
    """min(per_class, count) validation rows of each class, the rest is train."""
    return split_exact(split_rows(df), keys, per_class, seed, ("example_type",))


def split_stats(split: DataFrame) -> DataFrame:
    is_ = lambda name: F.sum((F.col("split") == name).cast("int"))
    return split.groupBy("example_type").agg(F.count("*").alias("kept"), is_("validation").alias("validation"), is_("train").alias("train"))
