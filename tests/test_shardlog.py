import os
import time

import pytest
from pyspark.sql import functions as F

from qaflow.sources import shardlog
from qaflow.sources.shardlog import Folder, planned, slices_between


def write(df, path, size=10, **options):
    df.write.format("shardlog").mode("append").options(rowsPerShard=size, **options).save(str(path))


def read(spark, path, **options):
    return [r[0] for r in spark.read.format("shardlog").options(**options).load(str(path)).collect()]


@pytest.fixture
def log(spark):
    spark.dataSource.register(shardlog.ShardLog)
    return spark


def files_of(path):
    return sorted(f for d, _, names in os.walk(f"{path}/data") for f in names)


def test_slices_and_plans():
    files = [("a", 7), ("b", 0), ("c", 5), ("d", 9)]
    rows = [(name, i) for name, n in files for i in range(n)]
    for first in range(22):
        for end in range(first, 22):
            assert [(f, i) for f, a, b in slices_between(files, first, end) for i in range(a, b)] == rows[first:end]
    for size in (1, 4, 10, 30):
        for world in (1, 3):
            for after in (0, 1, 5, 40):
                for rank in range(world):
                    own = [r for k, r in enumerate(rows) if k // size % world == rank]
                    parts = planned(files, size, 0, len(rows), world, rank, after)
                    assert [(f, i) for p in parts for f, a, b in p.value for i in range(a, b)] == own[after:]


def test_shards_are_exact_and_appends_fill_the_last(log, tmp_path):
    write(log.range(37).repartition(4), tmp_path)
    write(log.range(37, 64).repartition(3), tmp_path)
    assert sorted(read(log, tmp_path)) == list(range(64))
    parts = log.read.format("shardlog").load(str(tmp_path)).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sorted(r["count"] for r in parts) == [4, 10, 10, 10, 10, 10, 10]
    everything = [read(log, tmp_path, world=3, rank=r) for r in range(3)]
    assert sorted(sum(everything, [])) == list(range(64)) and sorted(map(len, everything)) == [20, 20, 24]
    for r, own in enumerate(everything):
        assert read(log, tmp_path, world=3, rank=r, after=13) == own[13:]


def test_many_small_shards_share_files_and_partitions(log, tmp_path):
    n, size = 30_000, 7
    write(log.range(0, 20_000, 1, 2), tmp_path, size=size)
    write(log.range(20_000, n, 1, 1), tmp_path, size=size)
    assert len(files_of(tmp_path)) < 100
    for rank, after in ((0, 0), (1, 13), (2, 5_000)):
        options = {"world": 3, "rank": rank, "after": after}
        found = log.read.format("shardlog").options(**options).load(str(tmp_path))
        assert found.rdd.getNumPartitions() <= shardlog.PARTITIONS
        assert [r[0] for r in found.collect()] == [k for k in range(n) if k // size % 3 == rank][after:]
    assert read(log, tmp_path) == list(range(n))


def test_plans_grow_with_the_shards():
    """Work of a plan: each file is looked at for the few shards in it, not for every shard."""
    looked = 0

    class Files(list):
        def __iter__(self):
            nonlocal looked
            looked += len(self)
            return super().__iter__()

        def __getitem__(self, i):
            nonlocal looked
            looked += 1
            return super().__getitem__(i)

    files = Files((f"f{i}", 3) for i in range(2_000))
    parts = planned(files, 2, 0, 6_000, 1, 0)
    rows = [(f, i) for p in parts for f, a, b in p.value for i in range(a, b)]
    assert rows == [(f"f{i}", k) for i in range(2_000) for k in range(3)]
    assert looked < 20_000 and len(parts) <= shardlog.PARTITIONS


def test_resume_opens_no_earlier_file(log, tmp_path):
    for i in range(5):
        write(log.range(10 * i, 10 * i + 10).coalesce(1), tmp_path)
    entries = Folder(str(tmp_path)).entries()
    names = [name for e in entries for name, _ in e["files"]]
    for name in names[:3]:
        os.remove(f"{tmp_path}/data/{name}")  # a read of any of these would fail
    assert read(log, tmp_path, after=30) == list(range(30, 50))


def test_a_failed_job_leaves_nothing_and_its_retry_gives_each_row_once(log, tmp_path):
    write(log.range(20).repartition(2), tmp_path)
    before = files_of(tmp_path)

    def lost(batches):
        for batch in batches:
            if 77 in batch.column(0).to_pylist():
                raise RuntimeError("executor lost")
            yield batch

    with pytest.raises(Exception, match="executor lost"):
        write(log.range(20, 100).repartition(8).mapInArrow(lost, "id long"), tmp_path)
    assert sorted(read(log, tmp_path)) == list(range(20))
    time.sleep(1)  # for tasks that were running when the job was given up
    Folder(str(tmp_path)).vacuum(0)
    assert files_of(tmp_path) == before
    write(log.range(20, 100).repartition(8), tmp_path)
    assert sorted(read(log, tmp_path)) == list(range(100))


def test_a_second_attempt_of_a_task_is_committed_alone(tmp_path):
    """What the first attempt had written is named by no message, and goes with the commit."""
    from types import SimpleNamespace
    from unittest import mock

    import pyarrow as pa
    from pyspark.sql import types as T

    writer = shardlog.ShardWriter({"path": str(tmp_path), "rowsPerShard": "3"}, T.StructType.fromDDL("id long"))

    def attempt(number, fail):
        def batches():
            yield pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4]})
            if fail:
                raise RuntimeError("lost")
            yield pa.RecordBatch.from_pydict({"id": [5]})

        with mock.patch("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: number)):
            return writer.write(batches())

    with pytest.raises(RuntimeError):
        attempt(1, True)
    message = attempt(2, False)
    assert len(files_of(tmp_path)) == 4
    writer.commit([message, None])
    assert [n for _, n in message.files] == [3, 2] and len(files_of(tmp_path)) == 2


def test_replays_and_rivals(log, tmp_path):
    write(log.range(15), tmp_path, transaction="batch-7")
    write(log.range(15), tmp_path, transaction="batch-7")  # a replay
    assert sorted(read(log, tmp_path)) == list(range(15))
    rival = shardlog.ShardWriter({"path": str(tmp_path), "rowsPerShard": "10"}, log.range(1).schema)
    seen = Folder.entries
    calls = []

    def stale(folder):
        """The first look at the log is from before the other writer's commit."""
        calls.append(1)
        return seen(folder)[:-1] if len(calls) == 1 else seen(folder)

    Folder.entries = stale
    try:
        rival.commit([])
    finally:
        Folder.entries = seen
    assert len(calls) == 2 and [e["transaction"] for e in Folder(str(tmp_path)).entries()] == ["batch-7", rival.job]
    with pytest.raises(Exception, match="10 rows a shard"):
        write(log.range(3), tmp_path, size=11)
    with pytest.raises(Exception, match="only appended"):
        log.range(3).write.format("shardlog").mode("overwrite").save(str(tmp_path))


def test_types_nulls_and_empty_tables(log, tmp_path):
    rows = [(1, None, ["a", None], {"k": 1.5}), (2, "", [], None), (None, "é" * 100_000, None, {})]
    df = log.createDataFrame(rows, "id int, text string, items array<string>, numbers map<string,double>")
    write(df, tmp_path)
    write(df.limit(0), tmp_path)
    found = log.read.format("shardlog").load(str(tmp_path))
    assert found.schema == df.schema and sorted(found.collect(), key=repr) == sorted(df.collect(), key=repr)
    assert log.read.format("shardlog").schema("id int").load(str(tmp_path)).count() == 3
    empty = tmp_path / "empty"
    write(df.limit(0), empty)
    assert log.read.format("shardlog").schema(df.schema).load(str(empty)).count() == 0


def test_stream_goes_on_at_its_row(log, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    for first, end in ((0, 25), (25, 70)):
        write(log.range(first, end).repartition(3), source)
        query = log.readStream.format("shardlog").load(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r[0] for r in log.read.parquet(out).collect()) == list(range(end))
