"""Seeded sampling, ranking and caps. All orders are md5 ranks of key and seed, so results do not depend on partitioning.

A global ``row_number()`` would pull every row into one task. ``exact_rank`` deals rows over buckets that
are monotone in the order, numbers them inside a bucket, and adds the bucket's offset from one small
table of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(keys: list[Column], seed: int | str) -> Column:
    """md5 hex of the keys and the seed joined by colons; nulls count as empty."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))).cast("binary"))


def hash_int(hashed: Column) -> Column:
    """The first 32 bits of an md5 hex string as a long."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")


def hash_long(hashed: Column) -> Column:
    """The first 60 bits of an md5 hex string as a long: a remainder by any number of rows is even to one in millions, and reaches all of them."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def hash01(keys: list[Column], seed: int | str) -> Column:
    """Uniform in [0, 1)."""
    return hash_int(seeded(keys, seed)).cast("double") / F.lit(4294967296.0)


def hash_bucket(hashed: Column) -> Column:
    """One of 65,536 buckets in the order of the md5: of 10^11 rows a bucket has 1.5 million, and the table of their counts stays small."""
    return F.conv(F.substring(hashed, 1, 4), 16, 10).cast("int")


def range_bucket(df: DataFrame, column: str, n: int = 64) -> Column:
    """One of about n * n bucket numbers that grow with an integer column.

    ``n`` approximate quantiles cut the range into parts of like size, and each part is cut into ``n`` of
    equal width, so that buckets stay small where values cluster too.
    """
    found = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000), F.min(column), F.max(column)).first()
    if found[1] is None:
        return F.lit(0)
    bounds = sorted({int(found[1]), *map(int, found[0]), min(int(found[2]) + 1, (1 << 63) - 1)})
    edges = F.lit(bounds).cast("array<long>")
    part = F.size(F.filter(edges, lambda b: b <= F.col(column))) - 1
    # in doubles, which no range of longs overflows; rounding keeps the order
    low, high = F.get(edges, part).cast("double"), F.get(edges, part + 1).cast("double")
    within = F.floor((F.col(column).cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * n).cast("int")
    return F.coalesce(part * n + F.greatest(F.least(within, F.lit(n - 1)), F.lit(0)), F.lit(-1))


def exact_rank(df: DataFrame, order: list[Column], bucket: Column, by: tuple[str, ...] = (), name: str = "rnk") -> DataFrame:
    """Add the 1-based rank of each row within ``by`` under ``order``; ``bucket`` must not decrease along the order."""
    rows = df.withColumn("__bucket", bucket)
    keys = [*by, "__bucket"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    for k in by:
        rows = rows.withColumn(f"__{k}", F.col(k))
        offsets = offsets.withColumnRenamed(k, f"__o_{k}")
    joined = rows.join(offsets.withColumnRenamed("__bucket", "__ob"), (F.col("__bucket") == F.col("__ob")) & _same(by), "inner")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return joined.withColumn(name, (F.col("__offset") + inside).cast("long")).select(*df.columns, name)


def _same(by: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in by:
        out = out & F.col(f"__{k}").eqNullSafe(F.col(f"__o_{k}"))
    return out


def shuffle_rank(df: DataFrame, keys: list[str], seed: int, by: tuple[str, ...] = (), name: str = "rnk") -> DataFrame:
    """Rank of each row (within ``by``) in the seeded shuffle of ``keys``."""
    h = seeded([F.col(k) for k in keys], seed)
    return exact_rank(df, [h, *[F.col(k) for k in keys]], hash_bucket(h), by, name)


def cap(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Shuffle and keep the first ``n``; all rows where ``n`` <= 0. A distributed top-k."""
    return df if n <= 0 else df.orderBy(seeded([F.col(k) for k in keys], seed), *keys).limit(n)


def split_exact(df: DataFrame, keys: list[str], k: int, seed: int, by: tuple[str, ...], names=("validation", "train")) -> DataFrame:
    """Exactly min(k, count) rows of each class go to the first split."""
    return shuffle_rank(df, keys, seed, by).withColumn("split", F.when(F.col("rnk") <= k, names[0]).otherwise(names[1])).drop("rnk")


def ratio_split(df: DataFrame, keys: list[str], ratio: float, seed: int) -> DataFrame:
    """eval gets min(max(1, int(n * ratio)), n - 1) rows; none if ratio <= 0 or n <= 1."""
    n = df.count()
    wanted = min(max(1, int(n * ratio)), n - 1) if ratio > 0 and n > 1 else 0
    return shuffle_rank(df, keys, seed).withColumn("split", F.when(F.col("rnk") <= wanted, "eval").otherwise("train")).drop("rnk")


def bernoulli(df: DataFrame, keys: list[str], p: float, seed: int) -> DataFrame:
    return df.where(hash01([F.col(k) for k in keys], seed) < p)


def round_robin(df: DataFrame, keys: list[str], workers: int, seed: int) -> DataFrame:
    """Worker numbers dealt in turn over the seeded shuffle."""
    return shuffle_rank(df, keys, seed).withColumn("worker", F.pmod(F.col("rnk") - 1, F.lit(workers)).cast("int")).drop("rnk")


def local_targets(spark, total: int, workers: int) -> DataFrame:
    """An even split of a total: the first ``total % workers`` workers get one more."""
    base, rest = divmod(total, workers)
    return spark.range(workers).select(F.col("id").cast("int").alias("worker"), (F.lit(base) + (F.col("id") < rest).cast("int")).cast("long").alias("target"))


def sample_classes(df: DataFrame, keys: list[str], wanted: dict[str, int], seed: int, replace: bool, by: str = "example_type") -> DataFrame:
    """``wanted[class]`` rows of each class: without replacement at most what there is, with replacement exactly that many.

    With replacement, draw i takes the row whose shuffle rank is a hash of i modulo the class size, so rows
    are looked up by an equi-join. The column ``draw`` numbers the copies.
    """
    ranked = shuffle_rank(df, keys, seed, (by,))
    limits = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, v)])
    if not replace:
        return ranked.where(F.col("rnk") <= F.coalesce(F.element_at(limits, F.col(by)), F.lit(0))).withColumnRenamed("rnk", "draw")
    sizes = ranked.groupBy(by).agg(F.count("*").alias("size"))
    spark = df.sparkSession
    draws = None
    for c, n in wanted.items():  # a distributed range for each of the few classes
        more = spark.range(1, n + 1).select(F.lit(c).alias(by), F.col("id").alias("draw"))
        draws = more if draws is None else draws.unionByName(more)
    pick = F.pmod(hash_long(seeded([F.col(by), F.col("draw")], seed)), F.col("size")) + 1
    return draws.join(sizes, by).select(by, "draw", pick.alias("rnk")).join(ranked, [by, "rnk"]).select(*df.columns, "draw")


def cycled_quota(df: DataFrame, keys: list[str], quota: int, seed: int) -> DataFrame:
    """``quota`` rows from a source that is reshuffled for each epoch when it runs out; adds ``epoch`` and ``pos``."""
    n = df.count()
    if not n or quota <= 0:
        return df.limit(0).withColumn("epoch", F.lit(0)).withColumn("pos", F.lit(0).cast("long"))
    epochs = -(-quota // n)
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    h = seeded([F.col("epoch"), *[F.col(k) for k in keys]], seed)
    ranked = exact_rank(rows, [h, *[F.col(k) for k in keys]], hash_bucket(h), ("epoch",), "pos")
    return ranked.withColumn("pos", F.col("pos") + F.col("epoch") * n).where(F.col("pos") <= quota)


def bankers_quota(n: int, ratio: float) -> int:
    """round() of Python: halves go to the even neighbour."""
    return round(n * ratio)
