"""Mixing sources to target weights by Poisson replication.

Source s with weight w and size n gets the repetition rate w * total / n. Each document's count is drawn
by inverting the Poisson distribution of that mean at a number hashed from the document and the seed,
so a re-run, or a lost task, draws the same counts. Documents are exploded by their counts and shuffled
globally by a hash of document, copy and seed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.llm.common import join_small, let, materialize, packed, unit_hash, unpacked

#: Poisson means above this are split into equal parts of at most this, each drawn with its own hash.
PART = 8.0
#: P(X > 48) is below 1e-20 for a mean of 8, less than the resolution of the hashed numbers.
_TERMS = 48


@dataclass(frozen=True)
class MixConfig:
    """Target weights by source; a source that is not named gets ``other``. ``size`` is the target's rows relative to the input's.

    ``temper`` applies where no weights are given: a source's weight is its share to that power, so 1
    keeps the natural mix and 0 makes sources equal.
    """

    weights: dict = field(default_factory=dict)
    other: float = 1.0
    temper: float = 0.5
    size: float = 1.0
    seed: int = 29


def rates(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(source_key, n_rows, rate): one row per source, a null source being one of its own."""
    sizes = materialize(docs.groupBy(_source_key()).agg(F.count("*").alias("n_rows")), "sizes")
    if config.weights:
        named = F.create_map(*[F.lit(x) for k, w in config.weights.items() for x in ("=" + k, float(w))])
        weight = F.coalesce(F.element_at(named, F.col("source_key")), F.lit(float(config.other)))
    else:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(config.temper))
    weighed = sizes.select("source_key", "n_rows", weight.alias("w"))
    w_all, n_all = weighed.agg(F.sum("w"), F.sum("n_rows")).first()  # two numbers
    if not w_all:
        return weighed.select("source_key", "n_rows", F.lit(0.0).alias("rate"))
    rate = F.lit(config.size) * F.lit(float(n_all)) * F.col("w") / F.lit(float(w_all)) / F.col("n_rows")
    return weighed.select("source_key", "n_rows", rate.alias("rate"))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("source_key")


def poisson_steps(mean: Column) -> Column:
    """The distribution function at 0, 1, 2, ... as an array: the count for u is the number of steps not above u."""
    terms = [1.0 / math.factorial(k) for k in range(_TERMS)]
    masses = F.transform(F.array(*map(F.lit, terms)), lambda t, k: F.exp(-mean) * F.pow(mean, k.cast("double")) * t)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps"))
    added = F.aggregate(
        masses, start, lambda acc, m: F.struct((acc["sum"] + m).alias("sum"), F.array_append(acc["steps"], acc["sum"] + m).alias("steps"))
    )
    return added["steps"]


def with_counts(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(row, doc_key, copies): each packed input row with its drawn count. The table of rates has a row for each source."""
    table = materialize(rates(docs, config).select("source_key", "rate"), "rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = packed(docs, key.alias("doc_key"), _source_key(), F.xxhash64("doc_id", "text").alias("spread"))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    drawn = let(
        poisson_steps(F.col("rate") / parts),
        lambda steps: F.transform(
            F.sequence(F.lit(1), parts),
            lambda part: let(
                unit_hash(F.col("doc_key"), str(config.seed), part.cast("string")), lambda u: F.size(F.filter(steps, lambda x: x <= u))
            ),
        ),
    )
    copies = F.aggregate(drawn, F.lit(0).cast("long"), lambda n, x: n + x)
    return join_small(rows, table, ["source_key"], F.col("spread")).select("row", "doc_key", copies.alias("copies"))


def mix(docs: DataFrame, config: MixConfig = MixConfig(), label: bool = True) -> DataFrame:
    """Replicated rows in a global random order, with all columns of ``docs``.

    With ``label``, two columns follow: ``copy_no`` from 1, and ``mix_order``, the number in [0, 1) by
    which the rows are ordered across partitions, then by doc_id and copy (an input column of either name is replaced). Counts
    depend on doc_id alone besides the source's rate: equal or null doc_ids of a source share a count.
    Null text and other nulls pass through; an empty table gives an empty result.
    """
    counted = with_counts(docs, config)
    copies = counted.where("copies > 0").select("row", "doc_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no"))
    order = unit_hash(F.col("doc_key"), "order", str(config.seed), F.col("copy_no").cast("string"))
    placed = copies.select("row", "doc_key", "copy_no", order.alias("mix_order"))
    # the order is uniform in [0, 1), so parts of equal width hold like numbers of rows, and no pass is needed to find their bounds
    n = _width(docs)
    dealt = placed.repartitionById(n, F.floor(F.col("mix_order") * n).cast("int"))
    shuffled = dealt.sortWithinPartitions("mix_order", "doc_key", "copy_no")
    if not label:
        return unpacked(shuffled, docs.columns)
    names = [c for c in docs.columns if c not in ("copy_no", "mix_order")]
    return shuffled.select(*[F.col("row").getField(c).alias(c) for c in names], "copy_no", "mix_order")


def _width(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
