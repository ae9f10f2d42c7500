"""Ratio-controlled training mixtures over three example classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaflow.operators.sampling import sample_classes, shuffle_rank
from qaflow.shared import write_once

CLASSES = ("correct", "refusal", "negative")


def allocate(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Largest-remainder allocation: floors first, then one each by descending fraction, ties in class order."""
    exact = {c: total * r for c, r in ratios.items()}
    given = {c: int(x) for c, x in exact.items()}
    by_fraction = sorted(exact, key=lambda c: given[c] - exact[c])
    for c in by_fraction[: total - sum(given.values())]:
        given[c] += 1
    return given


def class_counts(df: DataFrame) -> dict[str, int]:
    found = {r["example_type"]: r["n"] for r in df.groupBy("example_type").agg(F.count("*").alias("n")).collect()}
    return {c: found.get(c, 0) for c in CLASSES}


def requested(counts: dict[str, int], strategy: str, ratios: dict[str, float] | None = None, target: int = 0, oversample: bool = False) -> dict[str, int]:
    """Rows asked of each class under ``natural``, ``balanced`` or ``custom``."""
    present = {c: n for c, n in counts.items() if n}
    if strategy == "natural":
        return counts
    if strategy == "balanced":
        if target > 0:
            base, rest = divmod(target, len(CLASSES))
            return {c: base + (i < rest) for i, c in enumerate(CLASSES)}
        size = (max if oversample else min)(present.values(), default=0)
        return {c: size for c in CLASSES}
    if strategy == "custom":
        return allocate(target if target > 0 else sum(counts.values()), ratios or {c: 1 / 3 for c in CLASSES})
    raise ValueError(f"unknown strategy {strategy!r}")


def mix(df: DataFrame, keys: list[str], strategy: str, seed: int, ratios=None, target: int = 0, oversample: bool = False) -> DataFrame:
    """The mixture's rows with their draw number. An empty mixture is an error. Counting, ranking and picking read ``df`` from one written copy."""
    df = write_once(df, "mixture")
    counts = class_counts(df)
    if strategy == "natural":
        n = min(target, sum(counts.values())) if target > 0 else sum(counts.values())
        if not n:
            raise ValueError("the mixture is empty")
        return shuffle_rank(df, keys, seed, name="draw").where(F.col("draw") <= n)
    wanted = {c: n for c, n in requested(counts, strategy, ratios, target, oversample).items() if counts[c]}
    if not any(wanted.values()):
        raise ValueError("the mixture is empty")
    return sample_classes(df, keys, wanted, seed, oversample)


def selection_report(df: DataFrame, keys: list[str], wanted: dict[str, int], seed: int) -> DataFrame:
    """available, requested and selected rows of each class."""
    picked = sample_classes(df, keys, wanted, seed, False).groupBy("example_type").agg(F.count("*").alias("selected"))
    asked = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, v)])
    available = df.groupBy("example_type").agg(F.count("*").alias("available"))
    joined = available.join(picked, "example_type", "left")
    return joined.select(
        "example_type",
        "available",
        F.coalesce(F.element_at(asked, F.col("example_type")), F.lit(0)).cast("long").alias("requested"),
        F.coalesce("selected", F.lit(0)).cast("long").alias("selected"),
    )


def feasible_target(df: DataFrame, mixtures: dict[str, dict[str, float]], fraction: float, most: int) -> DataFrame:
    """For each mixture the largest size its classes allow, and the common target: least of them times ``fraction``, 1 to ``most``."""
    spark = df.sparkSession
    ratios = spark.createDataFrame([(m, c, float(r)) for m, rs in mixtures.items() for c, r in rs.items() if r > 0], "mixture string, example_type string, ratio double")
    counts = df.groupBy("example_type").agg(F.count("*").alias("n"))
    sizes = ratios.join(counts, "example_type", "left").groupBy("mixture").agg(
        F.floor(F.min(F.coalesce("n", F.lit(0)) / F.col("ratio"))).cast("long").alias("feasible")
    )
    least = sizes.agg(F.min("feasible")).first()[0] or 0
    target = min(max(int(least * fraction), 1), most)
    return sizes.select("mixture", "feasible", F.lit(target).cast("long").alias("target"))
