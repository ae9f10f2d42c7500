"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, given by an offset and a step that
are hashed from its name. Shards take turns, each claiming the next free slot of its permutation, until
all slots are taken; shares differ by at most one slot (or by the weights), and a change of shards
moves few slots. Placement is a hash of the key modulo the size and one look-up in the broadcast table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.llm.common import packed


@dataclass(frozen=True)
class ShardConfig:
    """``table_size`` is prime and well above the number of shards; it bounds what is broadcast."""

    shards: tuple = tuple(f"shard-{i:04d}" for i in range(64))
    table_size: int = 65_537
    seed: str = "placement"


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(config: ShardConfig = ShardConfig()) -> np.ndarray:
    """The shard number of every slot, filled by turns."""
    size, n = config.table_size, len(config.shards)
    if not _is_prime(size) or size > 1 << 20 or not 0 < n <= size or len(set(config.shards)) != n:
        raise ValueError("table_size must be a prime up to 2**20 (it is broadcast), and the shards distinct, one to table_size of them")
    offset, step = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, name in enumerate(config.shards):
        digest = hashlib.blake2b(f"{config.seed}:{name}".encode(), digest_size=16).digest()
        offset[i] = int.from_bytes(digest[:8], "little") % size
        step[i] = int.from_bytes(digest[8:], "little") % (size - 1) + 1
    table = np.full(size, -1, np.int32)
    at, taken = offset.copy(), 0
    while True:
        for i in range(n):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + step[i]) % size
            table[slot] = i
            at[i] = (slot + step[i]) % size
            taken += 1
            if taken == size:
                return table


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key's text: 60 bits of its md5 modulo ``size``; a null key goes where the text "null" goes."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", config: ShardConfig = ShardConfig()) -> DataFrame:
    """Each row of ``docs`` with ``slot``, ``shard`` (number) and ``shard_name`` after its columns.

    Input columns of those names are replaced. No shuffle: the look-up table, a row for each of the
    ``table_size`` slots whatever the input, is broadcast. Equal keys share a shard, repeated rows too; an empty table gives an
    empty result.
    """
    kept = [c for c in docs.columns if c not in ("slot", "shard", "shard_name")]
    numbers = lookup_table(config)
    table = pd.DataFrame({"slot": np.arange(config.table_size, dtype=np.int32), "shard": numbers, "shard_name": np.array(config.shards)[numbers]})
    table = docs.sparkSession.createDataFrame(table, "slot int, shard int, shard_name string")
    rows = packed(docs, slot_of(F.col(key), config.table_size).alias("slot"))
    placed = rows.join(F.broadcast(table), "slot")
    return placed.select(*[F.col("row").getField(c).alias(c) for c in kept], "slot", "shard", "shard_name")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", config: ShardConfig = ShardConfig(), parts: int = 1) -> None:
    """Write one folder per shard, each by ``parts`` tasks: the shuffle is on (shard, salt of the key), so no task holds a whole shard."""
    placed = place(docs, key, config)
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(parts))
    placed.repartition(len(config.shards) * parts, "shard", salt).write.partitionBy("shard_name").mode("errorifexists").parquet(path)
