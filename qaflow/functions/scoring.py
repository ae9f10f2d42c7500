"""Exact match, token F1 and grouped metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.functions.strings import normalize_answer, strip
from qaflow.functions.unicode import nfd


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays, by one walk over both, sorted together."""
    tag = lambda items, side: F.transform(items, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))
    # of equal tokens those of ``a`` come first; ``open`` of them wait for a partner
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        waiting = F.when(acc["t"] == x["t"], acc["open"]).otherwise(0)
        paired = (x["side"] == 1) & (waiting > 0)
        change = F.when(x["side"] == 0, 1).when(paired, -1).otherwise(0)
        return F.struct(x["t"].alias("t"), (waiting + change).alias("open"), (acc["n"] + paired.cast("int")).alias("n"))

    return F.aggregate(F.array_sort(F.concat(tag(a, 0), tag(b, 1))), start, step)["n"]


def exact_match(prediction: Column, gold: Column, normalize=normalize_answer) -> Column:
    return (normalize(prediction) == normalize(gold)).cast("double")


def token_f1(prediction: Column, gold: Column, normalize=normalize_answer) -> Column:
    """Harmonic mean of token precision and recall: 1 if both sides are empty, 0 if one is or nothing is shared."""
    split = lambda c: F.filter(F.split(normalize(c), " "), lambda t: t != "")
    p, g = split(prediction), split(gold)

    def of(tokens):
        # the overlap is bound once: inside a higher-order function each use would count anew
        counted = F.array(bag_overlap(tokens["p"], tokens["g"]))
        return F.element_at(F.transform(counted, lambda same: rate(same, F.size(tokens["p"]), F.size(tokens["g"]))), 1)

    def rate(same, n_p, n_g):
        precision, recall = same / n_p, same / n_g
        empty = F.when((n_p == 0) & (n_g == 0), 1.0).when((n_p == 0) | (n_g == 0) | (same == 0), 0.0)
        return empty.otherwise(2 * precision * recall / (precision + recall))

    return F.element_at(F.transform(F.array(F.struct(p.alias("p"), g.alias("g"))), of), 1)


def normalize_answer_nfd(c: Column) -> Column:
    """normalize_answer on decomposed text, where the mark of a letter ends a word."""
    return normalize_answer(nfd(F.coalesce(c, F.lit(""))))


def prediction_rows(df: DataFrame, gold: str, prediction: str, context: str, mode: str) -> DataFrame:
    """Result rows: id, stripped answers, type and level ("unknown" where null), the context's length and its mode."""
    known = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    return df.select(
        "id", strip(F.col(gold)).alias("gold_answer"), strip(F.col(prediction)).alias("prediction"), known("type"), known("level"),
        F.length(context).alias("context_chars"), F.lit(mode).alias("context_mode"),
    )


def breakdown(scored: DataFrame) -> DataFrame:
    """One pass over (type, level, em, f1): the total, each type and each level; null types and levels count as "unknown"."""
    named = scored.select(
        F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("level", F.lit("unknown")).alias("level"), "em", "f1"
    )
    grouped = named.groupingSets([[], ["type"], ["level"]], "type", "level").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("em").alias("em"), F.sum("f1").alias("f1")
    )
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "type").otherwise("level")
    rate = lambda c: F.round(100 * F.coalesce(F.col(c), F.lit(0.0)) / F.greatest(F.lit(1), F.col("n")), 6)
    return grouped.select(kind.alias("kind"), F.coalesce("type", "level", F.lit("")).alias("name"), F.col("n").alias("num_samples"), rate("em").alias("exact_match"), rate("f1").alias("f1"))
