"""Whole jobs from files to files: grounded rows, splits, mixtures, reasoning traces, native answers, scores, rewards and validations.

Each job is a configuration and a function that returns a small table about what it wrote. ``python -m qaflow``
runs them from the command line; the flags are the fields of the configurations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaflow import schemas
from qaflow.functions import metadata, parsers, scoring
from qaflow.functions.strings import IDK, canonical_answer, parse_ratios, strip, words
from qaflow.operators import filters, membership, mixing, rendering, rollouts, sampling, splits, status, synth, tasks, validation
from qaflow.operators.mixing import CLASSES
from qaflow.shared import write_once
from qaflow.sources import readers, sinks
from qaflow.streaming.inference import Provider, infer, infer_on_slots, infer_where_needed, stub_provider

QA = ["query", "context", "answer"]


@dataclass(frozen=True)
class GroundedConfig:
    """Jobs from a corpus: of the valid rows a share draws a mismatched context, and a few get none."""

    corpus: str
    output: str
    format: str = "parquet"
    language: str = "en"
    mismatch: float = 0.30
    missing: float = 0.005
    most_missing: int = 1000
    max_context: int = 6000
    rows_per_shard: int = 50_000
    seed: int = 11


def build_grounded(spark: SparkSession, c: GroundedConfig, provider: Provider = stub_provider) -> DataFrame:
    """(outcome, rows). Answers of the model have to be a JSON object whose quotes are in the context; what fails goes to ``<output>_failed``."""
    corpus = synth.valid_rows(readers.corpus(spark, c.corpus, c.format), c.language, max_context=c.max_context)
    fields = ["synth_id", "query", "query_seed_url"]
    # rows that agree in all fields are one, with the least context; numbered, so that keys are unique
    single = write_once(corpus.groupBy(*fields).agg(F.min("query_seed_text").alias("context")), "corpus-rows")
    rows = write_once(sampling.shuffle_rank(single, fields, c.seed, name="key").drop("synth_id"), "corpus")
    picked = synth.mismatched(rows, "key", "query_seed_url", "context", p=c.mismatch, seed=c.seed)
    partners = picked.join(rows.select(F.col("key").alias("partner_key"), F.col("context").alias("partner")), "partner_key").select("key", "partner")
    hits = synth.capped_hits(rows.select("key"), "key", c.missing, c.most_missing, c.seed + 1).select("key", F.lit(True).alias("hit"))
    joined = rows.join(partners, "key", "left").join(hits, "key", "left")
    jobs = synth.fan_out(joined, F.coalesce("hit", F.lit(False)), F.col("partner"), c.max_context)
    asked = jobs.withColumn("prompt", rendering.user_content(F.col("query"), F.col("context"), True, synth.CORPUS_IDK))
    made = write_once(infer_where_needed(asked, "prompt", "needs_infer", "answer", provider), "answers")  # the model runs once
    found = made.withColumn("object", F.when(F.col("needs_infer"), parsers.json_column(F.col("raw_output"))))
    said = F.when(F.col("needs_infer"), F.get_json_object("object", "$.answer")).otherwise(F.col("answer"))
    quotes = F.coalesce(F.from_json(F.get_json_object("object", "$.quotes"), "array<string>"), F.array().cast("array<string>"))
    parsed = found.withColumns({"said": strip(said), "quotes": quotes})
    reason = F.when(F.col("needs_infer") & F.col("object").isNull(), "unparsed").when(F.col("said") == "", "empty_answer")
    reason = reason.when(F.col("needs_infer") & ~synth.grounded(F.col("said"), F.col("quotes"), F.col("context")), "not_grounded")
    good, dead = sinks.routed(parsed.withColumn("reason", reason))
    answer = canonical_answer(F.col("said"), synth.CORPUS_IDK)
    counts = sinks.Outcomes(("unparsed", "empty_answer", "not_grounded"))
    rows = counts.written(good.select(F.col("is_negative").alias("negative"), "query", "context", answer.alias("answer")))
    sinks.write_shards(rows, c.output, c.rows_per_shard)
    sinks.append_dead_letters(counts.failed(dead.select("reason", "query", "context", "raw_output")), f"{c.output}_failed")
    return counts.table(spark)


@dataclass(frozen=True)
class SplitConfig:
    inputs: list[str]
    output: str
    per_class: int = 5000
    seed: int = 42
    rows_per_shard: int = 200_000


def build_splits(spark: SparkSession, c: SplitConfig) -> DataFrame:
    """Exact stratified splits in folders by split and class; returns kept, validation and train rows of each class."""
    rows = readers.parquet_globs(spark, c.inputs, [*QA, "negative"])
    made = splits.stratified(rows, QA, c.per_class, c.seed)
    sinks.write_splits(made.select(*QA, "negative", "example_type", "split"), c.output, c.rows_per_shard)
    return splits.split_stats(spark.read.parquet(c.output))


@dataclass(frozen=True)
class MixConfig:
    correct: list[str]
    refusal: list[str]
    negative: list[str]
    output: str
    strategy: str = "natural"
    ratios: str = ""
    target: int = 0
    oversample: bool = False
    max_words: int = 0
    seed: int = 42
    rows_per_shard: int = 200_000


def build_mixture(spark: SparkSession, c: MixConfig) -> DataFrame:
    """The training mixture of three class inputs, too long prompts left out (``max_words`` > 0); returns rows of each class."""
    rows = readers.grouped_datasets(spark, {"correct": c.correct, "refusal": c.refusal, "negative": c.negative}).select(*QA, "example_type")
    ratios = parse_ratios(c.ratios, CLASSES) if c.ratios else None
    mixed = mixing.mix(rows, QA, c.strategy, c.seed, ratios, c.target, c.oversample).drop("draw")
    if c.max_words > 0:
        mixed = filters.short_enough(mixed, rendering.bracket_prompt(F.col("query"), F.col("context")), c.max_words, tokens=words)
    sinks.write_new(mixed, c.output)
    return spark.read.parquet(c.output).groupBy("example_type").agg(F.count("*").alias("rows"))


@dataclass(frozen=True)
class TraceConfig:
    tasks: str
    output: str
    prompts: dict[str, str] = field(default_factory=lambda: {v: "Think first, then answer." for v in ("", *tasks.VERSIONS)})
    max_words: int = 256
    fallback: bool = True
    rows_per_shard: int = 50_000


def _unfinished(spark: SparkSession, path: str, output: str) -> DataFrame:
    """The tasks of a file, each once, without those that ``output`` has; a Bloom filter keeps most new ones out of the shuffle to the finished keys."""
    wanted = write_once(tasks.first_of_key(readers.task_file(spark, path), "prompt_version"), "wanted")
    done = sinks.existing(spark, output)
    return wanted if done is None else membership.anti_join(wanted, done.select("task_key"), "task_key")


def build_traces(spark: SparkSession, c: TraceConfig, provider: Provider = stub_provider) -> DataFrame:
    """Reasoning traces of the tasks without one, so a run after a failure goes on; returns (outcome, rows) of this run.

    Outputs without a usable answer go to ``<output>_failed`` and are tried again by the next run.
    """
    todo = _unfinished(spark, c.tasks, c.output)
    system = rendering.system_prompt(F.col("prompt_version"), c.prompts)
    prompt = F.concat_ws("\n\n", system, rendering.user_content(F.col("query"), F.col("context"), False, IDK))
    made = write_once(infer(todo.withColumn("prompt", prompt), "prompt", provider), "traces")  # the model runs once
    parsed = made.withColumn("p", parsers.cascade_column(F.col("raw_output"), c.max_words))
    judged = parsed.withColumn("policy", parsers.answer_policy(F.col("p"), F.col("raw_output"), F.col("reference_answer"), c.fallback))
    rows = judged.select(
        "query", "context", F.col("p.thinking").alias("thinking"), F.col("policy.answer").alias("answer"), "prompt_version", "reference_answer", "raw_output",
        F.col("p.parse_ok").alias("parse_ok"), F.col("policy.parse_method").alias("parse_method"), "task_key", F.col("policy.reason").alias("reason"),
    )
    good, dead = sinks.routed(rows)
    counts = sinks.Outcomes(("empty_answer", "empty_thinking"))
    sinks.write_shards(counts.written(good), c.output, c.rows_per_shard)
    sinks.append_dead_letters(counts.failed(dead), f"{c.output}_failed")
    return counts.table(spark)


@dataclass(frozen=True)
class ScoreConfig:
    predictions: str
    output: str
    nfd: bool = False


def score(spark: SparkSession, c: ScoreConfig) -> DataFrame:
    """Exact match and F1 of prediction lines, in all and by type and level; the table is written as JSON and returned."""
    normalize = scoring.normalize_answer_nfd if c.nfd else scoring.normalize_answer
    rows = readers.prediction_lines(spark, c.predictions).drop("em", "f1")
    prediction, gold = F.col("prediction_answer"), F.col("gold_answer")
    scored = rows.select("type", "level", scoring.exact_match(prediction, gold, normalize).alias("em"), scoring.token_f1(prediction, gold, normalize).alias("f1"))
    sinks.write_document(scoring.breakdown(scored), c.output)
    return spark.read.schema("kind string, name string, num_samples long, exact_match double, f1 double").json(c.output)


@dataclass(frozen=True)
class NativeConfig:
    """With ``slots`` > 0 the model runs in one stage of so many tasks that start together, on a GPU each where ``gpus`` > 0."""

    tasks: str
    output: str
    batch_size: int = 8
    slots: int = 0
    gpus: int = 0
    accept_slash: bool = True
    rows_per_shard: int = 50_000


def infer_native(spark: SparkSession, c: NativeConfig, provider: Provider = stub_provider) -> DataFrame:
    """Answers of a model with thinking and answer tokens of its own to the tasks without one; returns (outcome, rows) of this run.

    Outputs without an answer go to ``<output>_failed`` and are tried again by the next run.
    """
    asked = _unfinished(spark, c.tasks, c.output).withColumn("prompt", rendering.user_content(F.col("query"), F.col("context"), False, IDK))
    answered = infer_on_slots(asked, "prompt", c.slots, provider, c.batch_size, gpus=c.gpus) if c.slots else infer(asked, "prompt", provider, c.batch_size)
    parsed = write_once(answered, "native").withColumn("p", parsers.native_column(F.col("raw_output"), c.accept_slash))
    rows = parsed.select(
        "query", "context", "reference_answer", "prompt_version", "task_key", "raw_output", F.col("p.thinking").alias("thinking"), F.col("p.answer").alias("answer"),
        F.col("p.parse_method").alias("parse_method"), F.when(F.col("p.answer") == "", "empty_answer").alias("reason"),
    )
    good, dead = sinks.routed(rows)
    counts = sinks.Outcomes(("empty_answer",))
    sinks.write_shards(counts.written(good), c.output, c.rows_per_shard)
    sinks.append_dead_letters(counts.failed(dead), f"{c.output}_failed")
    return counts.table(spark)


@dataclass(frozen=True)
class RewardConfig:
    completions: str
    output: str
    format_weight: float = 0.2
    em_weight: float = 0.8
    eps: float = 1e-6


def reward(spark: SparkSession, c: RewardConfig) -> DataFrame:
    """Rewards of completion lines (group_id, prompt, completion, gold) and their advantages within a group; returns means and rates of all."""
    rows = spark.read.schema("group_id long, prompt string, completion string, gold string").json(c.completions)
    sinks.write_new(rollouts.advantages(rollouts.rewards(rows, c.format_weight, c.em_weight), c.eps), c.output)
    return rollouts.reward_stats(spark.read.parquet(c.output))


@dataclass(frozen=True)
class ValidateConfig:
    """``runs`` has a folder for each run with a ``*summary.json``; ``predictions`` are lines that name their ``run_name``."""

    runs: str
    predictions: str
    output: str
    log: str
    expected_rows: int = 0
    expected_samples: int = 0
    tokens: dict[str, str] = field(default_factory=dict)
    markers: dict[str, str] = field(default_factory=lambda: {"thinking_start": "<think>", "thinking_end": "</think>", "answer_start": "<answer>", "answer_end": "</answer>"})


def validate(spark: SparkSession, c: ValidateConfig) -> DataFrame:
    """Checks the runs that the status ``log`` doesn't have as finished: summary, format rates, sample count.

    The result rows are appended to ``output`` as JSON lines and, as events, to the log, so a run that failed is checked again by the next
    call and one that passed is not. Returns (run_name, group, status, errors) of this call.
    """
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*summary.json").text(c.runs)
    summaries = texts.select(F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]*$", 1).alias("job"), "value")
    due = status.unfinished(summaries, status.latest(spark, c.log), retries=1 << 30)
    runs = summaries.join(due, "job").select(
        F.col("job").alias("run_name"), "attempt", F.coalesce(metadata.group(F.col("value")), F.lit("")).alias("group"), metadata.summary(F.col("value")).alias("s")
    )
    checked = runs.select("run_name", "attempt", "group", "s.*").withColumn("metadata", validation.metadata_errors(c.expected_rows, c.tokens))
    predictions = spark.read.schema(T.StructType([*schemas.REASONED_PREDICTION.fields, T.StructField("run_name", T.StringType())])).json(c.predictions)
    rates = validation.format_rates(predictions, c.markers, by=("run_name",))
    joined = checked.join(rates.withColumn("gate", validation.gate_failures()), "run_name", "left")
    has_metrics, nothing = F.col("num_rows").isNotNull(), F.array().cast("array<string>")
    verdict = validation.run_status(
        F.lit(0), has_metrics, F.size("metadata") == 0, F.lit(True), F.size(F.coalesce("gate", nothing)) > 0, F.col("num_rows"), c.expected_samples
    )
    errors = F.concat(F.col("metadata"), F.coalesce("gate", nothing))
    made = write_once(joined.select("run_name", "attempt", "group", verdict.alias("status"), errors.alias("errors")), "validated")
    sinks.write_lines(made.drop("attempt"), c.output, "append")
    event = F.when(F.col("status") == "ok", "finish").otherwise("fail")
    events = made.select(F.col("run_name").alias("job"), "attempt", event.alias("event"), F.unix_millis(F.current_timestamp()).alias("at"), F.col("status").alias("detail"))
    status.append_events(events, c.log, status.next_batch(spark, c.log))
    return made.drop("attempt")


#: name: (configuration, job, whether it asks a model)
JOBS = {
    "grounded": (GroundedConfig, build_grounded, True),
    "splits": (SplitConfig, build_splits, False),
    "mixture": (MixConfig, build_mixture, False),
    "traces": (TraceConfig, build_traces, True),
    "score": (ScoreConfig, score, False),
    "native": (NativeConfig, infer_native, True),
    "reward": (RewardConfig, reward, False),
    "validate": (ValidateConfig, validate, False),
}
