import hashlib
from collections import Counter

import pytest

from qaflow.llm import sharding as S


def brute_table(config):
    """The definition: whole permutations, and turns over them."""
    size, perms = config.table_size, []
    for name in config.shards:
        d = hashlib.blake2b(f"{config.seed}:{name}".encode(), digest_size=16).digest()
        offset, step = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:], "little") % (size - 1) + 1
        perms.append([(offset + j * step) % size for j in range(size)])
    table, at = [-1] * size, [0] * len(perms)
    while -1 in table:
        for i, p in enumerate(perms):
            while at[i] < size and table[p[at[i]]] >= 0:
                at[i] += 1
            if at[i] < size:
                table[p[at[i]]] = i
    return table


@pytest.mark.parametrize("n", [1, 3, 7])
def test_equals_definition(n):
    config = S.ShardConfig(tuple(f"s{i}" for i in range(n)), 101)
    assert S.lookup_table(config).tolist() == brute_table(config)


def test_even_and_stable():
    config = S.ShardConfig()
    table = S.lookup_table(config)
    counts = Counter(table.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = S.lookup_table(S.ShardConfig(config.shards[:-1]))
    moved = sum(a != b for a, b in zip(table.tolist(), fewer.tolist()))
    assert moved < 0.1 * config.table_size  # a sixty-fourth must move


def test_bad_tables():
    for config in (S.ShardConfig(("a",), 100), S.ShardConfig(("a", "a"), 101), S.ShardConfig((), 101)):
        with pytest.raises(ValueError):
            S.lookup_table(config)


def test_placement(spark, tmp_path):
    config = S.ShardConfig(tuple(f"s{i}" for i in range(5)), 101)
    table = brute_table(config)
    df = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(None, "x")], "doc_id long, text string")
    for r in S.place(df, config=config).collect():
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"], r["shard_name"]) == (slot, table[slot], f"s{table[slot]}")
    S.write_shards(df, str(tmp_path / "out"), config=config, parts=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 301
