"""How document filters interact: what each removes in every order of application, and its Shapley share.

A document's failures are a mask of bits, and per part of the corpus only the counts of masks matter. With a switch x_i in
[0, 1] for each filter, the documents removed are the multilinear polynomial

    f(x) = sum over masks m of count[m] * (1 - product over i in m of (1 - x_i)).

Its value at a corner is what the filters switched on there remove, which gives every step of every order. The integral
of its partial derivative along the diagonal is a filter's Shapley value: the mean of what it removes over all orders.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.llm.common import let, materialize

#: More filters than this would give too many orders to list.
MOST_FILTERS = 7
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> Column:
    """Array of booleans, in this order: under 200 words; under half of the words distinct; over 3 % capitals A-Z; any of ``#$%&*|``.

    Words are maximal runs of other characters than space, tab and line ends; null text counts as empty.
    """

    def of(t: Column) -> Column:
        words = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
        return let(
            words,
            lambda w: F.array(
                F.size(w) < 200,
                F.size(F.array_distinct(w)) * 100 < F.size(w) * 50,
                F.regexp_count(t, F.lit("[A-Z]")).cast("long") * 100 > F.length(t).cast("long") * 3,
                t.rlike("[#$%&*|]"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def document_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row: bits 0 to 3 are ``text_failures``, bit 4 says that a smaller doc_id has the same text.

    Equal texts are found by their SHA-256. The least doc_id of each is one row, joined by text and doc_id together, so copies
    without number meet in no task. A null doc_id has no smaller one and is none itself; rows that share the least doc_id
    all pass. ``part`` is lang, or the empty string.
    """
    weighed = F.transform(text_failures(F.col("text")), lambda x, i: x.cast("int") * F.element_at(F.array(*[F.lit(1 << k) for k in range(4)]), i + 1))
    bits = F.aggregate(weighed, F.lit(0), lambda a, b: a + b)
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    table = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), digest.alias("digest"), bits.alias("bits")), "masks"
    )
    firsts = table.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return table.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("bits") + F.when(copy, 16).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each mask, and how many of them ``labels`` mark as quality 1 and as toxic 1.

    A doc_id with several labels counts as marked if any of them says so; one without labels is neither.
    """
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    return masks.join(marked, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients of f by the set of variables of a monomial, from the counts by mask."""
    above = list(counts)  # documents whose mask holds the set
    for bit in (1 << i for i in range(len(counts).bit_length() - 1)):
        for s in range(len(counts)):
            if not s & bit:
                above[s] += above[s | bit]
    return [0] + [above[s] if s.bit_count() % 2 else -above[s] for s in range(1, len(counts))]


def corners(polynomial: list[int]) -> list[int]:
    """Values of f where the variables of a set are 1 and the others 0, by set."""
    values = list(polynomial)
    for bit in (1 << i for i in range(len(values).bit_length() - 1)):
        for s in range(len(values)):
            if s & bit:
                values[s] += values[s ^ bit]
    return values


def shapley_value(polynomial: list[int], i: int) -> Fraction:
    """Integral over t from 0 to 1 of the partial derivative by variable ``i``, all variables being t."""
    derivative = [0] * len(polynomial).bit_length()  # coefficients by power of t
    for s, c in enumerate(polynomial):
        if s >> i & 1:
            derivative[s.bit_count() - 1] += c
    return sum((Fraction(c, power + 1) for power, c in enumerate(derivative)), Fraction(0))


def orders_of(part: str, names: str, counts: dict[str, list[int]]) -> list[tuple]:
    """Rows of one part: every order of the filters ``names``, step by step, from the counts (n, good, toxic) by mask."""
    total = sum(counts["n"])
    polynomials = {k: removal_polynomial(v) for k, v in counts.items()}
    removed = {k: corners(p) for k, p in polynomials.items()}
    scaled = [shapley_value(polynomials["n"], i) * factorial(len(names)) for i in range(len(names))]
    everything, rows = len(counts["n"]) - 1, []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            lost = {k: v[after] - v[before] for k, v in removed.items()}
            redundant = removed["n"][1 << i] - lost["n"]
            unique = removed["n"][everything] - removed["n"][everything ^ 1 << i]
            name = "".join(names[j] for j in order)
            rows.append((part, name, step, total - removed["n"][after], lost["n"], redundant, unique, lost["good"], lost["toxic"], int(scaled[i])))
            before = after
    return rows


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, zeros included, from (part, mask, n, good, toxic).

    Bit i of a mask stands for the filter named by the i-th letter of ``names``. A part is at most 2 ** filters rows of
    counts, so it is worked out in one place; parts are spread. ``shapley`` is the mean of what the filter removes over all
    orders, times their number, which is a whole number. No rows give no rows.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    kinds = ("n", "good", "toxic")
    entries = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *kinds)).alias("entries"))

    def run(batches):
        for batch in batches:
            for part in batch.to_pylist():
                by_kind = {k: [0] * (1 << len(names)) for k in kinds}
                for entry in part["entries"]:
                    for k in kinds:
                        by_kind[k][entry["mask"]] += entry[k]
                found = orders_of(part["part"], names, by_kind)
                fields = [c.split() for c in COLUMNS.split(", ")]
                kinds_of = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds_of[t]) for x, (_, t) in zip(zip(*found), fields)], [c for c, _ in fields])

    return entries.mapInArrow(run, COLUMNS)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters A to E (``document_masks``) over ``docs``, in all 120 orders, per language.

    Null text counts as empty and null lang as the empty string; texts of any length are measured whole; repeated rows count
    each time; extra columns are ignored; empty ``docs`` give no rows, and without labels nothing good or toxic is lost.
    """
    return interactions(mask_counts(document_masks(docs), labels), "ABCDE")
