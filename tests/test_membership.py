import pytest
from pyspark.sql import functions as F
from pyspark.sql import Observation

from qaflow.operators import membership as m


def keys(spark, n, tag="k"):
    return spark.range(n).select(F.concat(F.lit(tag), "id").alias("key"), "id")


@pytest.mark.parametrize("error", [0.3, 0.05, 0.005])
def test_members_pass_and_the_error_is_as_asked(spark, error):
    n = 20_000
    blocks = m.blocks_for(n, error)
    table = m.bloom_blocks(keys(spark, n), "key", blocks)
    assert m.flag_members(keys(spark, n), "key", table, blocks).where("NOT maybe").count() == 0
    wrong = m.flag_members(keys(spark, n, "other"), "key", table, blocks).where("maybe").count() / n
    assert wrong < 1.7 * error + 0.002


def test_filters_merge(spark):
    one, two = keys(spark, 300), keys(spark, 300, "b")
    both = m.bloom_blocks(one.union(two), "key", 9)
    parts = m.bloom_blocks(one, "key", 9).union(m.bloom_blocks(two, "key", 9))
    merged = parts.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(m.LANES)])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, both.collect()))


@pytest.mark.parametrize("most_bytes", [0, 64 << 20])
def test_equals_anti_join(spark, most_bytes):
    rows = keys(spark, 500).union(spark.createDataFrame([(None, 1), ("k3", 2), ("", 3)], "key string, id long"))
    done = keys(spark, 200).select("key").union(spark.createDataFrame([(None,), ("k1",)], "key string"))
    found = m.anti_join(rows, done, "key", most_bytes=most_bytes)
    assert found.columns == rows.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.join(done, "key", "left_anti").collect()))
    assert m.anti_join(rows, done.limit(0), "key", most_bytes=most_bytes).count() == 503
    assert m.anti_join(rows.limit(0), done, "key", most_bytes=most_bytes).count() == 0


def test_only_hits_are_shuffled(spark, tmp_path):
    """Of 50,000 tasks 1,000 are finished; the exchange into the exact anti join gets these and about one in a hundred others."""
    keys(spark, 50_000).write.parquet(f"{tmp_path}/tasks")
    rows, done = spark.read.parquet(f"{tmp_path}/tasks"), keys(spark, 1_000).select("key")
    found = m.anti_join(rows, done, "key", error=0.01)
    seen = Observation("out")
    assert found.observe(seen, F.count("*").alias("n")).count() == 49_000 == seen.get["n"]
    blocks = m.blocks_for(1_000, 0.01)
    hits = m.flag_members(rows, "key", m.bloom_blocks(done, "key", blocks), blocks).where("maybe").count()
    assert 1_000 <= hits < 2_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_the_exact_join_reads_the_hits_alone(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys(spark, 50_000).write.parquet(f"{tmp_path}/tasks")
        found = m.anti_join(spark.read.parquet(f"{tmp_path}/tasks"), keys(spark, 1_000).select("key"), "key", error=0.01)
        store = spark.sparkContext._jsc.sc().statusStore()
        before = {s.stageId() for s in _stages(store)}
        assert found.count() == 49_000
        written = sum(s.shuffleWriteRecords() for s in _stages(store) if s.stageId() not in before)
        assert written < 8_000  # hits, finished keys, blocks and partial counts; a plain anti join shuffles 51,000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _stages(store):
    found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [found.apply(i) for i in range(found.size())]
