import hashlib
import json

import pytest
from pyspark.sql import functions as F

from qaflow import schemas
from qaflow.sources import readers, sinks
from qaflow.streaming import inference, pool


def test_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_shards(spark.range(1000).coalesce(1), path, 300)
    sinks.write_shards(spark.range(1000, 1100).coalesce(1), path, 300)
    files = list((tmp_path / "out").glob("part-*.parquet"))
    assert len(files) == 5 and readers.row_count(spark, path) == 1100
    names = spark.createDataFrame([("part-00007-x.parquet",), ("other",)], "file string")
    assert sinks.next_shard(names).first()[0] == 8 and sinks.next_shard(names.limit(0)).first()[0] == 0


def test_refuses_existing_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_new(spark.range(3), path)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_new(spark.range(3), path)
    sinks.write_new(spark.range(2), path, allow_existing=True)
    assert spark.read.parquet(path).count() == 2


def test_split_folders_prune(spark, tmp_path):
    df = spark.range(20).select("id", F.when(F.col("id") < 5, "validation").otherwise("train").alias("split"), F.lit("correct").alias("example_type"))
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'validation'").count() == 5
    assert readers.parquet_globs(spark, [str(tmp_path / "s" / "split=train" / "*")], ["id"]).count() == 15


def test_task_lines(spark, tmp_path):
    good = tmp_path / "tasks.jsonl"
    good.write_text('{"query": " q ", "context": "c", "task_key": "old"}\n\n{"query": "", "context": "c"}\n')
    rows = readers.task_file(spark, str(good)).collect()
    assert len(rows) == 1 and rows[0]["query"] == "q" and rows[0]["task_key"] != "old"
    (tmp_path / "bad.jsonl").write_text('{"query": "q"\n')
    with pytest.raises(Exception):
        readers.task_file(spark, str(tmp_path / "bad.jsonl")).collect()


def test_formats(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([("é", None)], "query string, context string"), str(tmp_path / "x.jsonl"))
    text = "".join(p.read_text() for p in (tmp_path / "x.jsonl").glob("part-*"))
    assert json.loads(text) == {"query": "é", "context": None} and "é" in text
    df = readers.dataset_files(spark, [str(tmp_path / "x.jsonl")], ["query"], schemas.TASK)
    assert df.count() == 1
    with pytest.raises(ValueError, match="mixes"):
        readers.dataset_files(spark, ["a.parquet", "b.jsonl"], [])
    with pytest.raises(ValueError, match="missing"):
        readers.dataset_files(spark, [str(tmp_path / "x.jsonl")], ["nothing"])
    with pytest.raises(ValueError, match="all of"):
        readers.grouped_datasets(spark, {"correct": ["a"], "refusal": []})
    sinks.write_csv(spark.range(2), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id"]
    sinks.write_document(spark.range(1), str(tmp_path / "d"))
    good, bad = sinks.routed(spark.createDataFrame([(1, None), (2, "x")], "id int, reason string"))
    assert good.count() == bad.count() == 1 and good.columns == ["id"]
    sinks.append_dead_letters(bad, str(tmp_path / "dead"))
    sinks.append_dead_letters(bad, str(tmp_path / "dead"))
    assert spark.read.json(str(tmp_path / "dead")).count() == 2


def test_documents_and_unions(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "summary.json").write_text('{\n "train_rows": 5\n}')
    found = readers.json_documents(spark, str(tmp_path), schemas.T.StructType.fromDDL("train_rows long"))
    assert sorted(r["run_dir"].rsplit("/", 1)[1] for r in found.collect()) == ["r1", "r2"]
    both = readers.union_all(spark.range(1).select("id"), spark.range(1).withColumn("x", F.lit(1)))
    assert both.count() == 2 and both.columns == ["id", "x"]
    assert readers.shard(spark.range(10), "id", 3, 1).count() == 3 and readers.after_offset(spark.range(10), "id", 6).count() == 3


def test_multihop_scan(spark, tmp_path):
    rows = [("1", "q", "a", "t", "easy", (["A"], [["x", "y"]]), (["A"], [0]), "train"), ("2", "", "a", "t", "easy", (["A"], [["x"]]), ([], []), "test")]
    spark.createDataFrame(rows, schemas.T.StructType([*schemas.MULTIHOP.fields, schemas.T.StructField("split", schemas.T.StringType())])).write.partitionBy("split").parquet(str(tmp_path / "m"))
    qa = readers.multihop_to_qa(readers.multihop(spark, str(tmp_path / "m"), "train"), "supporting").collect()
    assert [(r["query"], r["context"]) for r in qa] == [("q", "A\nx")]
    assert readers.multihop(spark, str(tmp_path / "m")).count() == 2


def test_inference(spark):
    df = spark.createDataFrame([(1, "one two", True, "k"), (2, None, True, "k"), (3, "x", False, "known")], "id int, prompt string, ask boolean, known string")
    out = {r["id"]: r["raw_output"] for r in inference.infer_where_needed(df, "prompt", "ask", "known").collect()}
    assert out == {1: "<think>one two</think><answer>two</answer>", 2: "<think></think><answer></answer>", 3: "known"}
    assert inference.SamplingParams.for_mode(True) == inference.SamplingParams(0.6, 0.95, 20)


def expected_pool(ids, lanes=2, size=5, warm=2, seed=3):
    out, pools = set(), {}
    for e in ids:
        p = pools.setdefault(e % lanes, [])
        if len(p) >= warm:
            out.add((e % lanes, e, p[int(hashlib.md5(f"{e}:{seed}".encode()).hexdigest()[:8], 16) % len(p)], len(p)))
        pools[e % lanes] = [*p, e][-size:]
    return out


def test_streaming_pool_equals_batch_and_resumes(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(40).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(source)
    schema = schemas.T.StructType.fromDDL("event_id long")
    run = lambda: pool.run_pool(spark, source, schema, target, checkpoint, lanes=2, size=5, warm=2)
    assert {tuple(r) for r in run().collect()} == expected_pool(range(40))
    spark.range(40, 60).withColumnRenamed("id", "event_id").coalesce(1).write.mode("append").parquet(source)
    assert {tuple(r) for r in run().collect()} == expected_pool(range(60))


def test_rows_of_a_lane_are_held_as_columns():
    """A lane of 150,000 rows, out of order: no frame of all of them is made, and their Python objects are few at a time."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    n, ring, count = 150_000, {}, []
    shuffled = np.random.default_rng(1).permutation(n) * 2
    states = {
        "rows": SimpleNamespace(exists=lambda: bool(count), get=lambda: count[-1], update=count.append),
        "ring": SimpleNamespace(getValue=lambda k: ring[k], updateValue=ring.__setitem__),
    }
    processor = pool._processor(5, 2, 3, 1.0, 0)
    processor.init(SimpleNamespace(getValueState=lambda name, _: states[name], getMapState=lambda name, *_: states[name]))
    frames = (pd.DataFrame({"event_id": shuffled[i : i + 10_000], "url": "", "context": ""}) for i in range(0, n, 10_000))
    found, sizes = [], []
    tracemalloc.start()
    for frame in processor.handleInputRows((0,), frames, None):
        sizes.append(len(frame))
        found.append(frame[["lane", "event_id", "partner_id", "pool_size"]].astype("int64"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(sizes) <= 10_000 and peak < 25 << 20  # what is found takes 5 of these
    assert set(pd.concat(found).itertuples(index=False, name=None)) == expected_pool(range(0, 2 * n, 2))
    assert count == [(n,)] and {x[0] for x in ring.values()} == set(range(2 * n - 10, 2 * n, 2))


def test_batches_add_nothing_twice(spark, tmp_path):
    source, done = str(tmp_path / "in"), str(tmp_path / "done")
    spark.range(10).write.parquet(source)
    schema = schemas.T.StructType.fromDDL("id long")
    for check in ("c1", "c2"):  # a second run from the start sees everything again
        stream = spark.readStream.schema(schema).parquet(source)
        pool.process_batches(stream, lambda df: df.withColumn("y", F.col("id") * 2), done, "id", str(tmp_path / check)).awaitTermination()
    assert spark.read.parquet(done).count() == 10


def test_corpus_stream(spark, tmp_path):
    spark.createDataFrame([("en", "q", "c" * 400, "u", "l", "1"), ("fr", "q", "c" * 400, "u", "l", "2")], schemas.CORPUS).write.parquet(str(tmp_path / "corpus"))
    assert readers.corpus_to_qa(readers.corpus(spark, str(tmp_path / "corpus"))).count() == 1
    assert readers.corpus_stream(spark, str(tmp_path / "corpus")).isStreaming
