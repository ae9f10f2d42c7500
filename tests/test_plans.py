"""The plans keep what they were written for: push-down, pruning, no cross joins, no Python where SQL does."""

import pytest

from qaflow import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.load()
WITH_PYTHON = {"stub_inference", "slot_inference", "compat_task_keys", "logged_ranks_resumed"}  # the model boundary, and Unicode decomposition


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    if name not in WITH_PYTHON:
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_push_down_and_pruning(spark):
    text = plan(QUERIES["corpus_valid_rows"](spark, SF))
    assert "EqualTo(lang,en)" in text
    assert "n_chars" not in text and "source" not in text.split("ReadSchema")[1].split(">")[0]
    counts = plan(QUERIES["worker_round_robin"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in counts


def test_global_ranks_have_no_single_partition(spark):
    for name in ("mix_natural", "ratio_split", "worker_round_robin", "preceding_pool", "mismatched_context", "missing_tasks"):
        for part in plan(QUERIES[name](spark, SF)).split("Exchange SinglePartition")[1:]:
            # only the table of bucket counts may be gathered, or a final aggregate
            assert "n#" in part or "count" in part, name
