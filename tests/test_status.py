import random

from qaflow.operators import status


def brute(events):
    best = {}
    for e in events:
        key = (e[1], status.KINDS.index(e[2]), e[3], e[4] is not None, e[4] or "")
        if e[0] not in best or key > best[e[0]][0]:
            best[e[0]] = (key, e)
    return sorted((*e, status.STATES[e[2]]) for _, e in best.values())


def found(spark, path):
    return sorted(map(tuple, status.latest(spark, path).collect()))


def test_states_before_and_after_compaction_and_replays(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path)
    batches = [[(f"j{rng.randrange(12)}", rng.randrange(3), rng.choice(status.KINDS), rng.randrange(50), "d") for _ in range(30)] for _ in range(4)]
    assert found(spark, path) == [] and status.compact(spark, path) == -1
    put = lambda n: status.append_events(spark.createDataFrame(batches[n], status.EVENTS), path, n)
    put(0), put(1), put(1)
    seen = brute(batches[0] + batches[1])
    assert found(spark, path) == seen
    assert status.compact(spark, path) == 1 and found(spark, path) == seen
    put(0)  # a replay of what is compacted
    put(2)
    assert found(spark, path) == brute(sum(batches[:3], []))
    assert status.compact(spark, path) == 2 == status.compact(spark, path)
    put(3)
    assert found(spark, path) == brute(sum(batches, []))


def test_a_snapshot_that_was_not_finished_is_ignored(spark, tmp_path):
    path = str(tmp_path)
    status.append_events(spark.createDataFrame([("a", 0, "start", 1, None)], status.EVENTS), path, 0)
    spark.createDataFrame([("b", 0, "start", 1, None)], status.EVENTS).write.parquet(f"{path}/snapshots/0")  # without its line
    assert found(spark, path) == [("a", 0, "start", 1, None, "running")]
    assert status.compact(spark, path) == 0 and found(spark, path) == [("a", 0, "start", 1, None, "running")]


def test_what_runs_next(spark, tmp_path):
    events = [("a", 0, "finish", 2, None), ("b", 0, "fail", 2, "x"), ("c", 2, "fail", 2, "x"), ("d", 1, "start", 5, None), ("d", 0, "fail", 4, None)]
    status.append_events(spark.createDataFrame(events, status.EVENTS), str(tmp_path), 0)
    jobs = spark.createDataFrame([(x,) for x in "abcdee"], "job string")
    assert sorted(map(tuple, status.unfinished(jobs, status.latest(spark, str(tmp_path))).collect())) == [("b", 1), ("e", 0)]
