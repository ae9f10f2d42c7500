import pytest
from pyspark.sql import functions as F

from qaflow.functions import docs as D
from qaflow.functions import scoring
from qaflow.operators import filters, mixing, rendering, rollouts, sampling, splits, synth, tasks, validation


def frame(spark, n=200):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, "correct").when(F.col("id") % 10 < 9, "refusal").otherwise("negative").alias("example_type")
    )


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_ranks_do_not_depend_on_partitions(spark):
    one = sampling.shuffle_rank(frame(spark).repartition(1), ["id"], 3, ("example_type",))
    many = sampling.shuffle_rank(frame(spark).repartition(7), ["id"], 3, ("example_type",))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()}
    ranks = [r["rnk"] for r in sampling.shuffle_rank(frame(spark), ["id"], 3).collect()]
    assert sorted(ranks) == list(range(1, 201))


def test_rank_with_null_class_and_natural_order(spark):
    df = frame(spark).withColumn("example_type", F.when(F.col("id") % 2 == 0, F.col("example_type")))
    assert sampling.shuffle_rank(df, ["id"], 3, ("example_type",)).count() == 200
    rows = synth.ordered(frame(spark).select("id"), "id").collect()
    assert all(r["rn"] == r["id"] + 1 for r in rows)


def test_split_sizes(spark):
    split = sampling.split_exact(frame(spark), ["id"], 25, 1, ("example_type",))
    counts = {(r["example_type"], r["split"]): r["count"] for r in split.groupBy("example_type", "split").count().collect()}
    assert counts == {("correct", "validation"): 25, ("correct", "train"): 115, ("refusal", "validation"): 25, ("refusal", "train"): 15, ("negative", "validation"): 20}
    assert len(ids(split)) == 200
    for n, ratio, wanted in ((100, 0.1, 10), (3, 0.01, 1), (2, 1.0, 1), (1, 0.5, 0), (50, 0.0, 0)):
        assert sampling.ratio_split(spark.range(n), ["id"], ratio, 2).where("split = 'eval'").count() == wanted


def test_caps_and_cycles(spark):
    assert sampling.cap(frame(spark), ["id"], 0, 1).count() == 200 and sampling.cap(frame(spark), ["id"], 500, 1).count() == 200
    cycled = sampling.cycled_quota(spark.range(10), ["id"], 25, 4).collect()
    assert sorted(r["pos"] for r in cycled) == list(range(1, 26))
    assert all(sorted(r["id"] for r in cycled if r["epoch"] == e) == list(range(10)) for e in (0, 1))
    assert sampling.cycled_quota(spark.range(0), ["id"], 5, 4).count() == 0
    assert [r["target"] for r in sampling.local_targets(spark, 10, 4).orderBy("worker").collect()] == [3, 3, 2, 2]
    assert [sampling.bankers_quota(n, 0.5) for n in (1, 3, 5)] == [0, 2, 2]
    workers = sampling.round_robin(spark.range(20), ["id"], 6, 1).groupBy("worker").count().collect()
    assert sorted(r["count"] for r in workers) == [3, 3, 3, 3, 4, 4]


def test_mixtures(spark):
    ratios = {"correct": 0.5, "refusal": 0.25, "negative": 0.25}
    assert mixing.allocate(10, ratios) == {"correct": 5, "refusal": 3, "negative": 2} and sum(mixing.allocate(101, ratios).values()) == 101
    size = lambda df: {r["example_type"]: r["count"] for r in df.groupBy("example_type").count().collect()}
    assert size(mixing.mix(frame(spark), ["id"], "balanced", 1)) == {"correct": 20, "refusal": 20, "negative": 20}
    assert size(mixing.mix(frame(spark), ["id"], "balanced", 1, oversample=True)) == {"correct": 140, "refusal": 140, "negative": 140}
    assert size(mixing.mix(frame(spark), ["id"], "balanced", 1, target=20)) == {"correct": 7, "refusal": 7, "negative": 6}
    assert size(mixing.mix(frame(spark), ["id"], "custom", 1, ratios, 200)) == {"correct": 100, "refusal": 40, "negative": 20}
    assert mixing.mix(frame(spark), ["id"], "natural", 1, target=30).count() == 30
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, 0), ["id"], "balanced", 1)
    with pytest.raises(ValueError):
        mixing.requested({"correct": 1}, "other")


def test_context_encodings(spark):
    arrays = spark.sql("SELECT named_struct('title', array('A', 'B', 'C'), 'sentences', array(array('a1 ', ' a2'), array('b'))) AS c")
    pairs = spark.sql("SELECT array(named_struct('_1', 'A', '_2', array('a1 ', ' a2')), named_struct('_1', 'B', '_2', array('b'))) AS c")
    single = spark.sql("SELECT array(named_struct('title', 'A', 'sentence', 'a1 a2'), named_struct('title', 'B', 'sentence', 'b')) AS c")
    texts = []
    for df in (arrays, pairs, single):
        docs = D.context_docs(F.col("c"), df.schema["c"].dataType)
        texts.append(df.select(D.assemble(docs, F.array().cast("array<struct<title:string,sent_id:int>>"), "all")).first()[0])
    assert texts == ["A\na1 a2\n\nB\nb"] * 3
    facts = spark.sql("SELECT named_struct('title', array('A', 'B', 'A'), 'sent_id', array('1', 'x', '0')) AS s")
    found = facts.select(D.supporting_pairs(F.col("s"), facts.schema["s"].dataType)).first()[0]
    assert [tuple(x) for x in found] == [("A", 1), ("A", 0)]
    listed = spark.sql("SELECT array(named_struct('t', 'A', 'i', 1), named_struct('t', 'B', 'i', cast(null AS int))) AS s")
    assert [tuple(x) for x in listed.select(D.supporting_pairs(F.col("s"), listed.schema["s"].dataType)).first()[0]] == [("A", 1)]
    empty = spark.sql("SELECT cast(null AS struct<title:array<string>,sentences:array<array<string>>>) AS c")
    assert empty.select(D.context_docs(F.col("c"), empty.schema["c"].dataType)).first()[0] == []


def test_context_modes(spark):
    df = spark.sql(
        "SELECT array(named_struct('title', 'A', 'sentences', array('a0', 'a1')), named_struct('title', 'B', 'sentences', array('b0'))) AS d, "
        "array(named_struct('title', 'A', 'sent_id', 1), named_struct('title', 'Z', 'sent_id', 0)) AS p, array(named_struct('title', 'Z', 'sent_id', 0)) AS none"
    )
    get = lambda p, mode, cap=0: df.select(D.assemble(F.col("d"), F.col(p), mode, cap)).first()[0]
    assert get("p", "gold_titles") == "A\na0 a1" and get("p", "supporting") == "A\na1"
    assert get("none", "gold_titles") == get("none", "supporting") == get("p", "all") == "A\na0 a1\n\nB\nb0"
    assert get("p", "all", 9) == "A\na0 a1"


def test_contexts_evaluate_their_inputs_once(spark):
    """An input that a lambda names is evaluated again for each document or sentence, so each is named once, outside of them."""
    doc = [(("A", "B"), (["a0", None, "a2"], ["b0"])), (["A", "A", "A", "A", "A", "B"], ["2", "0", "2", "7", "-1", "x"])]
    df = spark.createDataFrame([doc], "held struct<title:array<string>,sentences:array<array<string>>>, facts struct<title:array<string>,sent_id:array<string>>")
    docs = D.context_docs(F.col("held"), df.schema["held"].dataType)
    pairs = D.supporting_pairs(F.col("facts"), df.schema["facts"].dataType)
    wanted = {"gold_titles": "A\na0 a2", "supporting": "A\na0 a2", "all": "A\na0 a2\n\nB\nb0"}
    for mode, found in wanted.items():
        made = df.select(D.assemble(docs, pairs, mode, 100))
        assert made.first()[0] == found
        shown = made._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
        # title and sentences of a context, title and ids of the facts
        assert (shown.count("held#"), shown.count("facts#")) == (2, 0 if mode == "all" else 2)
    made = df.select(D.select_passages(docs, D.supporting_titles(pairs), 1, F.lit(1), 1))
    shown = made._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert (shown.count("held#"), shown.count("facts#")) == (2, 2)


def test_passages(spark):
    df = spark.sql("SELECT transform(sequence(0, 9), i -> named_struct('title', concat('t', i), 'sentences', array(concat('s', i)))) AS d, array('t1', 't3', 't5') AS g")
    pick = lambda n: df.select(D.select_passages(F.col("d"), F.col("g"), n, F.lit(7), 1)).first()[0]
    assert len(pick(0)) == 10 and len(pick(4)) == 4
    assert {"t1 | s1", "t3 | s3", "t5 | s5"} <= set(pick(4)) and set(pick(2)) < {"t1 | s1", "t3 | s3", "t5 | s5"}
    assert set(pick(3)) == {"t1 | s1", "t3 | s3", "t5 | s5"}


def test_f1(spark):
    rows = [("the cat cat sat", "cat cat ran", 2 * (2 / 3 * 2 / 3) / (4 / 3)), ("", "", 1.0), ("the", "", 1.0), ("x", "", 0.0), ("x", "y", 0.0), ("A b!", "b a", 1.0)]
    df = spark.createDataFrame(rows, "p string, g string, f double")
    for r in df.select("f", scoring.token_f1(F.col("p"), F.col("g")).alias("found")).collect():
        assert abs(r["f"] - r["found"]) < 1e-9
    nfd = spark.createDataFrame([("à la", "à la")], "p string, g string")
    assert nfd.select(scoring.exact_match(F.col("p"), F.col("g"), scoring.normalize_answer_nfd)).first()[0] == 1.0


def test_breakdown_counts_unknown(spark):
    df = spark.createDataFrame([("t", None, 1.0, 1.0), ("t", "easy", 0.0, 0.5), (None, "easy", 0.0, 0.0)], "type string, level string, em double, f1 double")
    found = {(r["kind"], r["name"]): (r["num_samples"], r["exact_match"], r["f1"]) for r in scoring.breakdown(df).collect()}
    assert found[("total", "")] == (3, 33.333333, 50.0) and found[("level", "unknown")] == (1, 100.0, 100.0) and found[("type", "unknown")][0] == 1


def test_classes(spark):
    rows = [
        ("q", " ", "x", "true", "refusal"), ("q", "c", "I dont know", "no", "refusal"), ("q", "c", "i don't know", "1", "negative"), ("q", "c", "No relevant context", "1", "refusal"),
        ("q", "c", "Paris", "f", "correct"), ("", "c", "Paris", "f", "correct"), ("q", "c", None, "f", "correct"),
    ]
    df = spark.createDataFrame(rows, "query string, context string, answer string, negative string, expected string")
    assert all(r["expected"] == r["example_type"] for r in splits.classified(df).collect())
    assert splits.split_rows(df).count() == 5
    with pytest.raises(ValueError):
        splits.split_rows(df.drop("answer"))


def test_fan_out_and_grounding(spark):
    df = spark.createDataFrame([(1, "q", "c" * 30, True, "other"), (2, "q", "c", False, None)], "key long, query string, context string, m boolean, partner string")
    jobs = synth.fan_out(df, F.col("m"), F.col("partner"), 10).collect()
    assert [(r["key"], r["kind"], r["needs_infer"], len(r["context"])) for r in sorted(jobs, key=lambda r: (r["key"], r["job_no"]))] == [
        (1, "missing", False, 0), (1, "positive", True, 10), (1, "mismatched", False, 5), (2, "positive", True, 1),
    ]
    q = spark.createDataFrame([("a", ["c"]), ("a", ["zz"]), ("a", []), ("a", None), ("a", [" "]), (synth.CORPUS_IDK, None), ("a", ["c", None])], "a string, q array<string>")
    assert [r[0] for r in q.select(synth.grounded(F.col("a"), F.col("q"), F.lit("abc"))).collect()] == [True, False, False, False, False, True, False]


def test_partner_is_earlier(spark):
    df = spark.range(600).select(F.col("id"), F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("url"), F.lit("c").alias("context"))
    found = synth.mismatched(df, "id", "url", "context", pool=50).collect()
    assert len(found) == 600 - 256
    assert all(0 < r["id"] - r["partner_key"] <= 50 for r in found) and all(r["partner_url"] != f"u{r['id'] % 3}" for r in found)


def test_plan_covers_the_universe(spark):
    rows = spark.range(30).select(F.col("id").alias("k"), F.concat(F.lit("q"), (F.col("id") % 25).cast("string")).alias("query"), F.lit("c").alias("context"), F.lit(None).cast("string").alias("reference_answer"))
    all_ = tasks.with_key(tasks.fan_out_versions(rows, ["k"])).withColumn("ord", F.lpad(F.col("k").cast("string"), 5, "0"))
    done = all_.where("k % 4 = 0")
    planned = tasks.plan(all_, done, "ord", 4, 1)
    keys = lambda df: {r["task_key"] for r in df.select("task_key").collect()}
    assert keys(planned) | keys(done) == keys(all_) and not keys(planned) & keys(done) and planned.count() == len(keys(planned))
    assert sum(r["missing"] for r in tasks.by_worker(planned, 4).collect()) == planned.count()
    assert tasks.plan(all_, all_, "ord", 4, 1).count() == 0 and [r["missing"] for r in tasks.by_worker(tasks.plan(all_, all_, "ord", 4, 1), 4).collect()] == [0] * 4
    import hashlib

    one = spark.createDataFrame([("a", None)], "x string, y string")
    assert one.select(tasks.compat_task_key(F.col("x"), F.col("y"))).first()[0] == hashlib.blake2b(b"a\x1f\x1f", digest_size=16).hexdigest()
    assert one.select(tasks.task_key(F.col("x"), F.col("y"))).first()[0] == hashlib.sha256(b"a\x1f\x1f").hexdigest()


def test_advantages(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 0.5), (None, 1.0), (None, 0.0)], "group_id long, reward double")
    for f in (rollouts.advantages, rollouts.advantages_windowed):
        found = f(df).collect()
        assert len(found) == 5
        assert sorted(round(r["advantage"], 3) for r in found) == [-1.0, -1.0, 0.0, 1.0, 1.0]


def test_filters(spark):
    df = spark.createDataFrame([("q", "c", "a", "t", "a"), ("q", "c", "a", " ", "a"), ("q", "c", "a", "t", "b"), (None, "c", "a", "t", "a")], "query string, context string, answer string, thinking string, reference_answer string")
    assert [r["rows"] for r in filters.stage_counts(df).orderBy("stage_no").collect()] == [4, 3, 2, 1]
    assert filters.quality_filter(df).count() == 1 and filters.quality_filter(df, require_thinking=False, correct_only=False).count() == 3
    out = spark.createDataFrame([("<think>x</think>", "col", " a "), ("none", "col", "a")], "raw_output string, thinking string, answer string")
    assert [r["thinking"] for r in filters.reasoning_fields(out).collect()] == ["x", "col"]
    with pytest.raises(ValueError):
        filters.reasoning_fields(out.drop("thinking"))
    labels = spark.range(1).select(filters.masked_labels(F.array(*map(F.lit, range(5))), F.array(*map(F.lit, [1, 1, 1, 1, 0])), F.lit(2))).first()[0]
    assert labels == [-100, -100, 2, 3, -100]
    assert spark.range(1).select(filters.masked_labels(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(1)), F.lit(9))).first()[0] == [-100, -100]


def test_validation(spark):
    label = spark.createDataFrame([("a/checkpoint-120/", 120), ("checkpoint-x", -1), ("final", -1), ("checkpoint-7", 7)], "l string, s long")
    assert all(r["s"] == r[1] for r in label.select("s", validation.checkpoint_step(F.col("l"))).collect())
    evals = spark.createDataFrame([("r", "c1", 1, 0.5), ("r", "c2", 2, 0.9), ("r", "c3", 3, 0.9), ("s", "c1", 1, None)], "run_name string, label string, ordinal int, exact_match double")
    assert [tuple(r) for r in validation.best_checkpoint(evals).collect()] == [("r", "c2", 0.9)]
    rates = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {**validation.MINIMA, "missing_required_keys_rate": 0.25, "answer_start_rate": 0.5}.items()])
    assert rates.select(validation.gate_failures()).first()[0] == ["answer_start_rate=0.5000 < 0.9500", "missing_required_keys_rate=0.2500 > 0.0000"]
    run = spark.createDataFrame([("v1", 10, ["v1"], ["v1"], {"a": "x"}), ("v1", None, ["v2"], None, {"a": "y", "require_thinking": "no"})], "`group` string, train_rows long, prompt_versions array<string>, allowed_versions array<string>, args map<string,string>")
    errors = [r[0] for r in run.select(validation.metadata_errors(10, {"a": "x"})).collect()]
    assert errors[0] == [] and len(errors[1]) == 5
    losses = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r["mean_group_loss"] for r in validation.mean_group_loss(losses, ["a", "b", "c"]).collect()] == [2.0, None]
    assert validation.grid(spark, {"x": [1, 2], "y": ["a", "b", "c"]}).count() == 6
    assert validation.pending(spark.range(5), spark.range(3), "id").count() == 2
    groups = spark.createDataFrame([(["v1"], ""), (["v1", "v2"], "v3"), ([], "a,b")], "p array<string>, a string")
    assert [r[0] for r in groups.select(validation.group_of_summary(F.col("p"), F.col("a"))).collect()] == ["v1", "v3", None]


def test_rendering(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(rendering.numbered(F.array(F.lit("x"), F.lit("y")))) == "[1] x\n[2] y"
    assert one(rendering.reasoning_target(F.lit(" t "), F.lit("a"))) == "[thinking_start]t[thinking_end][answer_start]a[answer_end]"
    assert [m["role"] for m in one(rendering.messages(F.lit("s"), F.lit("u"), F.lit(None).cast("string")))] == ["system", "user"]
    assert one(rendering.system_prompt(F.lit("v1"), {"v1": "p"})) == "p"
    with pytest.raises(Exception, match="unknown prompt version"):
        one(rendering.system_prompt(F.lit("v9"), {"v1": "p"}))


def test_ranks_of_keys_over_the_whole_range(spark):
    keys = [-(1 << 63), -(1 << 63) + 1, -5, 0, 7, 1 << 40, (1 << 63) - 2, (1 << 63) - 1] + [k * 0x1234567890ABCDE for k in range(-7, 8)]
    df = spark.createDataFrame([(k,) for k in sorted(set(keys), key=lambda k: k % 11)], "k long").repartition(3)
    found = [r["k"] for r in synth.ordered(df, "k").orderBy("rn").collect()]
    assert found == sorted(set(keys))


def test_compat_keys_equal_python(spark):
    import hashlib

    parts = [("q", "c", None, "v1"), ("", "é\x1f", "日", None), ("a" * 100_000, "", "", "")]
    rows = spark.createDataFrame(parts, ", ".join(f"{c} string" for c in tasks.KEY_PARTS))
    for r in rows.withColumn("key", tasks.compat_task_key(*[F.col(c) for c in tasks.KEY_PARTS])).collect():
        assert r["key"] == hashlib.blake2b("".join((x or "") + "\x1f" for x in r[:4]).encode(), digest_size=16).hexdigest()
