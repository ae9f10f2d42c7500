"""A Bloom filter as a small table: built by aggregation, tested by a broadcast join, all in SQL expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8
_BITS = 64 * LANES
#: Bytes that a broadcast block takes, its bits and the hash table around them.
BLOCK_BYTES = 128


def blocks_for(keys: int, error: float) -> int:
    """Blocks of eight longs that let one in 1 / ``error`` keys pass that is not among ``keys``.

    A key sets one bit in each lane of its block, so the error is about (1 - exp(-8 n / m)) ** 8 for n keys in m bits.
    """
    per_key = -LANES / math.log1p(-(error ** (1 / LANES)))
    return max(1, math.ceil(keys * per_key / _BITS))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its bit in each lane."""
    block = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))
    bits = F.xxhash64(key, F.lit(2))
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(LANES)]


def bloom_blocks(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, b0 .. b7): the filter over the non-null values of ``column``; empty blocks are left out.

    Filters of the same number of blocks merge by OR-ing their lanes, which is what the partial aggregation of each task does.
    """
    block, bits = _place(F.col(column), blocks)
    rows = keys.where(F.col(column).isNotNull()).select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(LANES)])


def flag_members(rows: DataFrame, column: str, filter_blocks: DataFrame, blocks: int, name: str = "maybe") -> DataFrame:
    """``rows`` with whether their key may be in the filter; false is certain. The filter is broadcast, so its size has to be checked before."""
    block, bits = _place(F.col(column), blocks)
    renamed = filter_blocks.select(F.col("block").alias("__block"), *[F.col(f"b{i}").alias(f"__b{i}") for i in range(LANES)])
    joined = rows.withColumn("__at", block).join(F.broadcast(renamed), F.col("__at") == F.col("__block"), "left")
    hit = F.col("__block").isNotNull()
    for i, bit in enumerate(bits):
        hit = hit & (F.col(f"__b{i}").bitwiseAND(bit) != 0)
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(name))


def anti_join(rows: DataFrame, done: DataFrame, key: str, error: float = 0.01, most_bytes: int = 64 << 20) -> DataFrame:
    """Rows whose ``key`` is not among those of ``done``; the same rows as a left anti join, whatever the sizes.

    A count of ``done`` sizes a Bloom filter. Up to ``most_bytes`` it is broadcast; rows that it rules out stay where they are,
    and only the others are shuffled to the exact anti join. Beyond that size the anti join takes all rows. ``rows`` is
    evaluated twice, so it should be a table or cheap. Rows with a null key stay.
    """
    n = done.count()
    blocks = blocks_for(n, error)
    if blocks * BLOCK_BYTES > most_bytes:
        return rows.join(done.select(key), key, "left_anti").select(*rows.columns)
    flagged = flag_members(rows, key, bloom_blocks(done, key, blocks), blocks, "__maybe")
    sure = flagged.where(~F.col("__maybe")).drop("__maybe")
    doubtful = flagged.where("__maybe").drop("__maybe").join(done.select(key), key, "left_anti").select(*rows.columns)
    return sure.unionByName(doubtful)
