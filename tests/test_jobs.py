"""The jobs from files to files, with small corpora and stand-in models."""

import json

import pytest
from pyspark.sql import functions as F

from qaflow import jobs, schemas
from qaflow.__main__ import main, parser
from qaflow.sources import sinks


def json_provider():
    """Quotes the context's first words, but answers in plain text where the question is odd."""

    def generate(prompts):
        out = []
        for p in prompts:
            context = p.split("CONTEXT:\n")[1].split("\n\nQUESTION:")[0]
            number = int(p.split("question ")[1].split()[0])
            quote = " ".join(context.split()[:3]) if number % 4 else "not in there"
            out.append("no json" if number % 5 == 0 else json.dumps({"answer": f"a{number}", "quotes": [quote]}))
        return out

    return generate


def tag_provider():
    return lambda prompts: [f"<think>{p[:20]}</think><answer>{'' if 'q3' in p else 'Paris'}</answer>" for p in prompts]


def test_grounded(spark, tmp_path):
    rows = [("en" if i % 10 else "fr", f"question {i} ?", f"text {i} " + "word " * 100, f"u{i % 50}", "cc", str(i)) for i in range(600)]
    spark.createDataFrame(rows, schemas.CORPUS).write.parquet(str(tmp_path / "corpus"))
    out = str(tmp_path / "grounded")
    stats = {r["outcome"]: r["rows"] for r in jobs.build_grounded(spark, jobs.GroundedConfig(str(tmp_path / "corpus"), out, missing=0.05), json_provider).collect()}
    asked = [i for i in range(600) if i % 10]
    assert stats["unparsed"] == sum(i % 5 == 0 for i in asked) and stats["not_grounded"] == sum(i % 5 != 0 and i % 4 == 0 for i in asked)
    made = spark.read.parquet(out)
    assert made.count() == stats["written"] and made.columns == ["negative", "query", "context", "answer"]
    positive = made.where("NOT negative")
    assert positive.count() == sum(i % 5 != 0 and i % 4 != 0 for i in asked)
    assert positive.where(F.col("answer") != F.concat(F.lit("a"), F.regexp_extract("query", "question ([0-9]+)", 1))).count() == 0
    kinds = {r["answer"] for r in made.where("negative").select("answer").distinct().collect()}
    assert kinds == {"I can't find the answer in the context", "i dont see any relevant context."}
    assert spark.read.json(f"{out}_failed").count() == stats["unparsed"] + stats["not_grounded"]


def test_splits_then_mixture(spark, tmp_path):
    kinds = [("c", "a", False), ("", "a", False), ("c", "a", True)]
    rows = [(f"q{i}", kinds[i % 3][0] and f"c{i}", "a", kinds[i % 3][2]) for i in range(300)]
    spark.createDataFrame(rows, "query string, context string, answer string, negative boolean").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "splits")
    stats = {r["example_type"]: (r["kept"], r["validation"], r["train"]) for r in jobs.build_splits(spark, jobs.SplitConfig([str(tmp_path / "in")], out, per_class=20)).collect()}
    assert stats == {k: (100, 20, 80) for k in ("correct", "refusal", "negative")}
    classes = {k: [f"{out}/split=train/example_type={k}"] for k in stats}
    config = jobs.MixConfig(**classes, output=str(tmp_path / "mix"), strategy="custom", ratios="correct:2,refusal:1,negative:1", target=100)
    assert {r["example_type"]: r["rows"] for r in jobs.build_mixture(spark, config).collect()} == {"correct": 50, "refusal": 25, "negative": 25}
    with pytest.raises(Exception, match="(?i)exist"):
        jobs.build_mixture(spark, config)


def test_traces_resume(spark, tmp_path):
    rows = [(f"q{i}", f"context {i}", "Paris", "v1") for i in range(10)]
    df = spark.createDataFrame(rows, "query string, context string, reference_answer string, prompt_version string")
    sinks.write_lines(df.where("query < 'q5'"), str(tmp_path / "tasks"))
    config = jobs.TraceConfig(str(tmp_path / "tasks"), str(tmp_path / "traces"), fallback=False)
    run = lambda: {r["outcome"]: r["rows"] for r in jobs.build_traces(spark, config, tag_provider).collect()}
    assert run() == {"written": 4, "empty_answer": 1}
    sinks.write_lines(df.where("query >= 'q5'"), str(tmp_path / "tasks"), "append")
    assert run() == {"written": 5, "empty_answer": 1}  # the failed one again, and what is new
    made = spark.read.parquet(config.output)
    assert made.count() == made.select("task_key").distinct().count() == 9 and made.where("answer = 'Paris' AND parse_method = 'answer_tag'").count() == 9
    assert run() == {"empty_answer": 1} and spark.read.parquet(config.output).count() == 9


def test_score_from_the_command_line(spark, tmp_path, capsys):
    rows = [("1", "The Paris", "paris", "bridge", None), ("2", "Rome", "Oslo", "bridge", "hard")]
    sinks.write_lines(spark.createDataFrame(rows, "id string, gold_answer string, prediction_answer string, type string, level string"), str(tmp_path / "p"))
    main(["score", "--predictions", str(tmp_path / "p"), "--output", str(tmp_path / "s"), "--nfd"])
    found = {(r["kind"], r["name"]): r["exact_match"] for r in spark.read.json(str(tmp_path / "s")).collect()}
    assert found == {("total", ""): 50.0, ("type", "bridge"): 50.0, ("level", "unknown"): 100.0, ("level", "hard"): 0.0}
    assert "exact_match" in capsys.readouterr().out


def native_provider():
    return lambda prompts: ["<think>t</think><|answer_start|>Oslo<|answer_end|>" if "q1" not in p else "" for p in prompts]


@pytest.mark.parametrize("slots", [0, 2])
def test_native_answers_resume(spark, tmp_path, slots):
    rows = [(f"q{i}", f"context {i}", "Oslo", "v1") for i in range(6)]
    sinks.write_lines(spark.createDataFrame(rows, "query string, context string, reference_answer string, prompt_version string"), str(tmp_path / "tasks"))
    config = jobs.NativeConfig(str(tmp_path / "tasks"), str(tmp_path / "native"), slots=slots)
    run = lambda: {r["outcome"]: r["rows"] for r in jobs.infer_native(spark, config, native_provider).collect()}
    assert run() == {"written": 5, "empty_answer": 1} and run() == {"empty_answer": 1}
    made = spark.read.parquet(config.output)
    assert made.count() == 5 and {r["answer"] for r in made.collect()} == {"Oslo"}


def test_rewards(spark, tmp_path):
    good, bad = "<think>a</think><answer>Oslo</answer>", "Oslo"
    rows = [(1, "p", good, "Oslo"), (1, "p", bad, "Oslo"), (2, "p", good, "Rome")]
    sinks.write_lines(spark.createDataFrame(rows, "group_id long, prompt string, completion string, gold string"), str(tmp_path / "c"))
    stats = jobs.reward(spark, jobs.RewardConfig(str(tmp_path / "c"), str(tmp_path / "r"))).first()
    assert round(stats["format_rate"], 6) == 0.666667 and round(stats["em_rate"], 6) == 0.333333
    made = {(r["group_id"], r["completion"]): (round(r["reward"], 6), round(r["advantage"], 3)) for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert made == {(1, good): (1.0, 1.0), (1, bad): (0.0, -1.0), (2, good): (0.2, 0.0)}


def test_validation_goes_on_with_what_failed(spark, tmp_path):
    def summary(run, train_rows):
        (tmp_path / "runs" / run).mkdir(parents=True, exist_ok=True)
        found = {"train_rows": train_rows, "prompt_versions_filter": ["v1"], "train_prompt_version_filter": {"allowed": ["v1"]}, "args": {"require_thinking": True}}
        (tmp_path / "runs" / run / "sft_summary.json").write_text(json.dumps(found))

    for run, n in (("good", 10), ("short", 9), ("silent", 10), ("loose", 10)):
        summary(run, n)
    text = "<think>t</think><answer>a</answer>"
    lines = [(run, "q", text if run != "loose" or i else "a", "a", "t", 1.0, 1.0) for run in ("good", "short", "loose") for i in range(5)]
    names = "run_name string, id string, raw_generation string, prediction_answer string, prediction_thinking string, em double, f1 double"
    sinks.write_lines(spark.createDataFrame(lines, names), str(tmp_path / "p"))
    config = jobs.ValidateConfig(*[str(tmp_path / x) for x in ("runs", "p", "out", "log")], expected_rows=10)
    run = lambda: {r["run_name"]: (r["status"], len(r["errors"])) for r in jobs.validate(spark, config).collect()}
    first = run()
    assert first == {"good": ("ok", 0), "short": ("validation_failed", 1), "silent": ("eval_failed_missing_metrics", 0), "loose": ("validation_failed", 4)}
    summary("short", 10)
    assert run() == {"short": ("ok", 0), "silent": first["silent"], "loose": first["loose"]}
    assert sorted(run()) == ["loose", "silent"]
    assert spark.read.json(config.output).count() == 9


def test_flags():
    given = vars(parser().parse_args(["mixture", "--correct", "a", "b", "--refusal", "c", "--negative", "d", "--output", "o", "--oversample", "--target", "5"]))
    assert given == {"job": "mixture", "correct": ["a", "b"], "refusal": ["c"], "negative": ["d"], "output": "o", "oversample": True, "target": 5}
    with pytest.raises(SystemExit):
        parser().parse_args(["splits", "--output", "o"])
