import datetime
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaflow.streaming import answers, pool, target

CHUNKS = "stream string, seq long, chunk string, last boolean, ts timestamp"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


@given(st.text("abc", max_size=30), st.text("abc", max_size=5), st.lists(st.integers(0, 4), max_size=40))
@settings(max_examples=500, deadline=None)
def test_cutter_equals_split(text, marker, widths):
    cutter, out, begin, cut = answers.MarkerCutter(marker), "", 0, False
    for width in [*widths, len(text)]:
        piece, cut = cutter.feed(text[begin : begin + width])
        out, begin = out + piece, begin + width
        if cut:
            break
    assert out + ("" if cut else cutter.rest()) == (text.split(marker)[0] if marker else text)
    assert cut == (bool(marker) and marker in text)


def answers_run(spark, base, rows):
    spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = answers.cut_streams(spark.readStream.schema(CHUNKS).parquet(f"{base}/in"), "<end>")
    return sorted(map(tuple, pool.append_available(stream, f"{base}/out", f"{base}/check").collect()))


def test_answers_over_runs(spark, tmp_path):
    first = [("a", 0, "hel", False, at(0)), ("a", 1, "lo<e", False, at(1)), ("b", 0, "x<en", False, at(0)), ("c", 1, "later", True, at(0)), ("d", 0, None, False, at(0)), ("e", 1, "lost", True, at(0))]
    assert answers_run(spark, tmp_path, first) == [("a", 0, "hel", "open"), ("a", 1, "lo", "open"), ("b", 0, "x", "open"), ("d", 0, "", "open")]
    second = [("a", 2, "nd>no", False, at(90_000)), ("a", 3, "more", True, at(90_001)), ("c", 0, "first ", False, at(5)), ("c", 0, "first ", False, at(5)), ("d", 1, "<e", True, at(6))]
    assert answers_run(spark, tmp_path, second) == [
        ("a", 0, "hel", "open"), ("a", 1, "lo", "open"), ("a", 2, "", "cut"), ("b", 0, "x", "open"), ("b", 1, "<en", "abandoned"),
        ("c", 0, "first ", "open"), ("c", 1, "later", "end"), ("d", 0, "", "open"), ("d", 1, "<e", "end"), ("e", 0, "", "abandoned"),
    ]


def drawn(rows, lanes, size, warm, ratio, retries, seed=3):
    """The pool in plain Python: a list for each lane."""
    h = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)
    out, lists = [], {}
    for event, url in rows:
        held = lists.setdefault(event % lanes, [])
        last = held[-size:]
        if last and len(last) >= warm and h(event, seed, "draw") < ratio * 2**32:
            for t in range(retries + 1):
                pick = last[(h(event, seed, t) if t else h(event, seed)) % len(last)]
                if pick[1] != (url or ""):
                    break
            out.append((event % lanes, event, *pick, t, len(last)))
        held.append((event, url or ""))
    return sorted(out), {k: v[-size:] for k, v in lists.items()}


@pytest.mark.parametrize("options", [{"size": 7, "warm": 3, "ratio": 0.6, "retries": 2}, {"size": 50, "warm": 0, "ratio": 1.0, "retries": 10}])
def test_pool_of_urls_over_runs(spark, tmp_path, options):
    rows = [(i, [None, "", "u1", "u2", "u1"][i * 7 % 5]) for i in range(120)]
    schema = "event_id long, url string, context string"
    for n, part in enumerate((rows[:70], rows[70:])):
        spark.createDataFrame([(*r, f"c{r[0]}") for r in part], schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = pool.draw_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lanes=2, **options)
        found = pool.append_available(stream, f"{tmp_path}/out", f"{tmp_path}/check").collect()
        expected, held = drawn(rows[: 120 if n else 70], 2, **options)
        assert sorted((r["lane"], r["event_id"], r["partner_id"], r["partner_url"], r["tries"], r["pool_size"]) for r in found) == expected
        assert all(r["partner_context"] == f"c{r['partner_id']}" for r in found)
        state = pool.pool_state(spark, f"{tmp_path}/check").collect()
        assert {k: sorted((r["event_id"], r["url"]) for r in state if r["lane"] == k) for k in held} == {k: sorted(v) for k, v in held.items()}
        assert {r["lane"]: r["n"] for r in pool.pool_counters(spark, f"{tmp_path}/check").collect()} == {0: 60 if n else 35, 1: 60 if n else 35}


@pytest.mark.parametrize("files", [1, 3, 100])
def test_target_is_met_exactly_for_any_batches(spark, tmp_path, files):
    spark.range(200).repartition(9).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    run = lambda n: target.run_to_target(stream(), lambda b: b.where("id % 2 = 0"), n, ["id"], f"{tmp_path}/out", f"{tmp_path}/check")
    assert run(33) == 33 and run(33) == 33
    rows = target.read_committed(spark, f"{tmp_path}/out", "id long")
    assert rows.count() == rows.distinct().count() == rows.where("id % 2 = 0").count() == 33
    more = run(1000)  # the input ends first; what the cut left out of its batch is not taken up again
    assert 33 <= more <= 100 and target.read_committed(spark, f"{tmp_path}/out", "id long").distinct().count() == more


def test_failed_and_replayed_batches_add_nothing(spark, tmp_path):
    spark.range(90).repartition(6).write.parquet(f"{tmp_path}/in")
    failures = iter([False, True, False, True, True])

    def work(batch):
        if next(failures, False):
            raise RuntimeError("lost")
        return batch

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        return target.run_to_target(stream, work, 75, ["id"], f"{tmp_path}/out", f"{tmp_path}/check")

    for _ in range(3):
        with pytest.raises(Exception, match="lost"):
            run()
    assert run() == 75
    # a replay of everything, as if the checkpoint were lost: batches have the same numbers, so their log lines are overwritten
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    assert target.run_to_target(stream, lambda b: b, 75, ["id"], f"{tmp_path}/out", f"{tmp_path}/other") == 75
    assert target.read_committed(spark, f"{tmp_path}/out", "id long").select(F.countDistinct("id")).first()[0] == 75
    assert target.read_committed(spark, f"{tmp_path}/none") is None
