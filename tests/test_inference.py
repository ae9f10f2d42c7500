import os
import uuid
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaflow.sources import sinks
from qaflow.streaming import inference


@given(st.lists(st.integers(0, 9), max_size=12), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_batches_are_full_over_frames(sizes, size):
    start, frames = 0, []
    for n in sizes:
        frames.append(pd.DataFrame({"x": range(start, start + n)}))
        start += n
    batches = list(inference.full_batches(iter(frames), size))
    assert [x for b in batches for x in b["x"]] == list(range(start))
    assert all(len(b) == size for b in batches[:-1]) and len(batches) == -(-start // size)


def counting(folder):
    """A provider that leaves a file for each call, named by its task and number of prompts."""

    def provider():
        def generate(prompts):
            from pyspark import TaskContext

            open(f"{folder}/{TaskContext.get().partitionId()}-{len(prompts)}-{uuid.uuid4().hex}", "w").close()
            return [p.upper() for p in prompts]

        return generate

    return provider


@pytest.mark.parametrize("slots", [0, 3])
def test_calls_of_each_task(spark, tmp_path, slots):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames and batches don't fit each other
    try:
        rows = spark.range(100).select("id", F.when(F.col("id") % 9 != 0, F.concat(F.lit("p"), "id")).alias("prompt")).repartition(3)
        made = inference.infer(rows, "prompt", counting(tmp_path), 10) if not slots else inference.infer_on_slots(rows, "prompt", slots, counting(tmp_path), 10)
        found = {r["id"]: r["raw_output"] for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {i: f"P{i}" if i % 9 else "" for i in range(100)}
    calls = [tuple(map(int, name.split("-")[:2])) for name in os.listdir(tmp_path)]
    if slots:
        probes = [(t, 1) for t in range(slots)]
        for p in probes:
            calls.remove(p)
    rows_of, calls_of = Counter(), Counter()
    for task, n in calls:
        rows_of[task] += n
        calls_of[task] += 1
    assert sum(rows_of.values()) == 100 and all(calls_of[t] == -(-rows_of[t] // 10) for t in rows_of)


def test_one_slot_that_fails_to_start_fails_all(spark):
    def provider():
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 1:
            raise OSError("no model here")
        return lambda prompts: prompts

    with pytest.raises(Exception, match="slot 1: OSError: no model here"):
        inference.infer_on_slots(spark.range(20).select(F.col("id").cast("string").alias("prompt")), "prompt", 2, provider).collect()


def test_a_provider_that_loses_texts_is_an_error(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    with pytest.raises(Exception, match="1 texts for 2 prompts"):
        inference.infer(rows, "prompt", lambda: lambda prompts: prompts[:1]).collect()


def test_empty_input(spark):
    assert inference.infer_on_slots(spark.createDataFrame([], "prompt string"), "prompt", 2).count() == 0


def test_parameters_of_requests(spark):
    rows = spark.createDataFrame([(True, None, None), (False, 0.1, 5), (None, None, 7)], "thinking boolean, t double, k int")
    found = rows.select(inference.sampling_columns(F.col("thinking"), temperature=F.col("t"), top_k=F.col("k")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in found] == [(0.6, 0.95, 20, 512), (0.1, 0.8, 5, 512), (0.7, 0.8, 7, 512)]


def test_outcomes_are_counted_by_the_writes(spark, tmp_path):
    rows = spark.createDataFrame([(i, [None, "a", "b", "zzz"][i % 4]) for i in range(10)], "id int, reason string")
    good, dead = sinks.routed(rows)
    counts = sinks.Outcomes(("a", "b", "never"))
    sinks.write_shards(counts.written(good), f"{tmp_path}/out", 100)
    sinks.append_dead_letters(counts.failed(dead), f"{tmp_path}/failed")
    assert {r["outcome"]: r["rows"] for r in counts.table(spark).collect()} == {"written": 3, "a": 3, "b": 2, "other": 2}
