"""Task keys, scans of finished work, plans of the missing work."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.functions.strings import strip
from qaflow.operators.sampling import round_robin, seeded
from qaflow.schemas import require_columns
from qaflow.shared import write_once

VERSIONS = ("v1", "v2", "v3")
KEY_PARTS = ["query", "context", "reference_answer", "prompt_version"]


def task_key(*parts: Column) -> Column:
    """sha256 over the parts, nulls as empty, each followed by the unit separator."""
    joined = F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\x1f"))])
    return F.sha2(joined.cast("binary"), 256)


def compat_task_key(*parts: Column) -> Column:
    """The same parts under 128-bit blake2b, for outputs that carry such keys."""

    @F.pandas_udf("string")
    def run(joined: pd.Series) -> pd.Series:
        return joined.map(lambda s: hashlib.blake2b(s.encode("utf-8", "ignore"), digest_size=16).hexdigest())

    return run(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\x1f"))]))


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("task_key", task_key(*[F.col(c) for c in KEY_PARTS]))


def fan_out_versions(df: DataFrame, keys: list[str], mode: str = "all", seed: int = 5) -> DataFrame:
    """One row per prompt version: ``all`` three, ``mix`` one by hash, else the given version."""
    if mode == "all":
        versions = F.array(*map(F.lit, VERSIONS))
    elif mode == "mix":
        pick = F.conv(F.substring(seeded([F.col(k) for k in keys], seed), 1, 8), 16, 10).cast("long") % len(VERSIONS)
        versions = F.array(F.get(F.array(*map(F.lit, VERSIONS)), pick.cast("int")))
    else:
        versions = F.array(F.lit(mode))
    return df.withColumn("prompt_version", F.explode(versions))


def first_of_key(df: DataFrame, order: str) -> DataFrame:
    """One row per task key, the one with the least ``order``; by aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in ("task_key", order)]
    best = df.groupBy("task_key").agg(F.min(F.struct(order, *rest)).alias("b"))
    return best.select("task_key", "b.*").select(*df.columns)


def tasks_from_rows(df: DataFrame) -> DataFrame:
    """Stripped task fields with a recomputed key; rows without query or context go."""
    clean = df.select(*[strip(F.col(c)).alias(c) for c in KEY_PARTS])
    return with_key(clean.where("query <> '' AND context <> ''"))


def completed_scan(outputs: DataFrame) -> DataFrame:
    """Rows, distinct keys, and distinct keys of each known version, of previous outputs (older ones may lack optional columns)."""
    require_columns(outputs, ["query", "context"])
    for c in ("reference_answer", "prompt_version"):
        if c not in outputs.columns:
            outputs = outputs.withColumn(c, F.lit(""))
    keyed = with_key(outputs)
    per_key = keyed.groupBy("task_key", "prompt_version").agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.countDistinct("task_key").alias("distinct_keys"),
        *[F.countDistinct(F.when(F.col("prompt_version") == v, F.col("task_key"))).alias(f"keys_{v}") for v in VERSIONS],
    )


def missing(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks whose key is not among the finished ones."""
    return tasks.join(done.select("task_key"), "task_key", "left_anti")


def plan(tasks: DataFrame, done: DataFrame, order: str, workers: int, seed: int) -> DataFrame:
    """Distinct missing tasks dealt over workers in a seeded shuffle; the anti-join is evaluated once for counting and ranking."""
    return round_robin(write_once(missing(first_of_key(tasks, order), done), "missing"), ["task_key"], workers, seed)


def by_worker(planned: DataFrame, workers: int) -> DataFrame:
    """Missing tasks of every worker, idle ones included."""
    counts = planned.groupBy("worker").agg(F.count("*").alias("n"))
    all_ = planned.sparkSession.range(workers).select(F.col("id").cast("int").alias("worker"))
    return all_.join(counts, "worker", "left").select("worker", F.coalesce("n", F.lit(0)).alias("missing"))
