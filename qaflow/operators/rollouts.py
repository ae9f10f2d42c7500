"""Rewards, group-normalised advantages and policy objectives of sampled completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaflow.functions.parsers import ordered_tags
from qaflow.functions.scoring import exact_match
from qaflow.operators.sampling import hash_long, seeded, shuffle_rank
from qaflow.shared import write_once


def replicate(prompts: DataFrame, group_size: int) -> DataFrame:
    """Each prompt ``group_size`` times, with its copy number."""
    return prompts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(group_size))))


def rewards(df: DataFrame, format_weight: float = 0.2, em_weight: float = 0.8) -> DataFrame:
    """format_reward, em_reward (0 for an empty answer) and their weighted sum."""
    parsed = df.withColumn("parsed", ordered_tags(F.col("completion")))
    em = F.when(F.col("parsed.answer") == "", 0.0).otherwise(exact_match(F.col("parsed.answer"), F.col("gold")))
    scored = parsed.withColumn("format_reward", F.col("parsed.format_ok").cast("double")).withColumn("em_reward", em)
    return scored.withColumn("reward", F.lit(format_weight) * F.col("format_reward") + F.lit(em_weight) * F.col("em_reward")).drop("parsed")


def advantages(df: DataFrame, eps: float = 1e-6, group: str = "group_id") -> DataFrame:
    """(reward - mean) / (population deviation + eps) within the group.

    Statistics are aggregated and joined back, so that a large group is combined before the shuffle.
    """
    stats = df.groupBy(group).agg(F.avg("reward").alias("__m"), F.stddev_pop("reward").alias("__s"))
    joined = df.join(stats.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn("advantage", (F.col("reward") - F.col("__m")) / (F.col("__s") + F.lit(eps))).drop("__g", "__m", "__s")


def advantages_windowed(df: DataFrame, eps: float = 1e-6, group: str = "group_id") -> DataFrame:
    """The same over a window, for groups that are small by construction."""
    w = Window.partitionBy(group)
    return df.withColumn("advantage", (F.col("reward") - F.avg("reward").over(w)) / (F.stddev_pop("reward").over(w) + F.lit(eps)))


def reward_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("reward").alias("reward_mean"),
        F.stddev_pop("reward").alias("reward_std"),
        F.avg("format_reward").alias("format_rate"),
        F.avg("em_reward").alias("em_rate"),
    )


def sample_eval(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows drawn with replacement, numbered by ``draw``; all rows once where ``n`` is not positive or not less than their number."""
    rows = write_once(df, "eval")
    size = rows.count()
    ranked = shuffle_rank(rows, keys, seed, name="draw")
    if n <= 0 or n >= size:
        return ranked
    pick = F.pmod(hash_long(seeded([F.col("draw")], seed)), F.lit(size)) + 1
    draws = df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw")).select("draw", pick.alias("__at"))
    return draws.join(ranked.withColumnRenamed("draw", "__at"), "__at").select(*df.columns, "draw")


def eval_rates(scored: DataFrame, format_weight: float = 0.2, em_weight: float = 0.8) -> DataFrame:
    """eval_format_rate, eval_em_rate and their weighted sum eval_reward; zeros without rows."""
    rate = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    found = scored.agg(rate("format_reward").alias("eval_format_rate"), rate("em_reward").alias("eval_em_rate"))
    return found.withColumn("eval_reward", F.lit(format_weight) * F.col("eval_format_rate") + F.lit(em_weight) * F.col("eval_em_rate"))


def grpo_objective(advantage: Column, logp: Column, logp_ref: Column, beta: float) -> Column:
    return advantage * logp - F.lit(beta) * (logp - logp_ref)


def clipped_ratio_objective(advantage: Column, logp: Column, logp_ref: Column, beta: float, clip: float) -> Column:
    """The lesser of the plain and the clipped ratio times the advantage; the log ratio is held within 20 either way."""
    log_ratio = F.least(F.greatest(logp - logp_ref, F.lit(-20.0)), F.lit(20.0))
    ratio = F.exp(log_ratio)
    clipped = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    return F.least(ratio * advantage, clipped * advantage) - F.lit(beta) * (logp - logp_ref)
