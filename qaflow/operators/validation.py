"""Format rates, gates, statuses and rankings of evaluated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaflow.functions.strings import strip

#: The gates' default thresholds.
MINIMA = {
    "thinking_start_rate": 0.90,
    "thinking_end_rate": 0.85,
    "answer_start_rate": 0.95,
    "answer_end_rate": 0.95,
    "nonempty_thinking_rate": 0.90,
    "nonempty_answer_rate": 0.98,
}
MAX_MISSING = 0.0
RATES = [*MINIMA, "missing_required_keys_rate"]


def format_rates(df: DataFrame, markers: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows with each marker, with parsed fields, and without a required field; one pass, per ``by``."""
    raw = F.coalesce(F.col("raw_generation"), F.lit(""))
    lacks = F.lit(False)
    for c in ("prediction_answer", "prediction_thinking", "raw_generation", "em", "f1"):
        lacks = lacks | F.col(c).isNull()
    tests = {f"{k}_rate": F.contains(raw, F.lit(v)) if v else F.lit(False) for k, v in markers.items()} | {
        "nonempty_thinking_rate": strip(F.col("prediction_thinking")) != "",
        "nonempty_answer_rate": strip(F.col("prediction_answer")) != "",
        "missing_required_keys_rate": lacks,
    }
    counted = df.groupBy(*by).agg(F.count("*").alias("num_rows"), *[F.count_if(t).alias(n) for n, t in tests.items()])
    return counted.select(*by, "num_rows", *[(F.col(n) / F.greatest(F.lit(1), F.col("num_rows"))).alias(n) for n in tests])


def _fixed(c: Column) -> Column:
    """Four decimals."""
    return F.format_string("%.4f", c.cast("double"))


def gate_failures(minima: dict[str, float] = MINIMA, max_missing: float = MAX_MISSING) -> Column:
    """The failed checks of a row of rates, in order, as texts."""

    def check(name: str, sign: str, bound: float, bad: Column) -> Column:
        said = F.concat(F.lit(f"{name}="), _fixed(F.col(name)), F.lit(f" {sign} {bound:.4f}"))
        return F.when(F.col(name).isNull(), F.lit(f"{name} is missing")).when(bad, said)

    checks = [check(n, "<", b, F.col(n) < b) for n, b in minima.items()]
    checks.append(check("missing_required_keys_rate", ">", max_missing, F.col("missing_required_keys_rate") > max_missing))
    return F.array_compact(F.array(*checks))


def metadata_errors(expected_rows: int, tokens: dict[str, str]) -> Column:
    """Errors of a run's summary row: train_rows, versions (array), args (map), and the group it claims.

    The row has group, train_rows, prompt_versions, allowed_versions (both array<string>), args map<string,string>.
    """
    show = lambda c: F.coalesce(F.concat(F.lit("["), F.array_join(c, ","), F.lit("]")), F.lit("null"))
    group = F.array(F.col("group"))
    flag = lambda k: F.lower(F.coalesce(F.element_at("args", F.lit(k)), F.lit("true"))).isin("1", "true", "t", "yes", "y")
    errors = [
        F.when(F.col("train_rows").isNull(), F.lit("missing train_rows")).when(
            (F.lit(expected_rows) > 0) & (F.col("train_rows") != expected_rows), F.concat(F.lit("train_rows="), F.col("train_rows").cast("string"), F.lit(f", expected={expected_rows}"))
        ),
        F.when(~F.col("prompt_versions").eqNullSafe(group), F.concat(F.lit("prompt_versions="), show(F.col("prompt_versions")))),
        F.when(F.col("allowed_versions").isNull(), F.lit("missing allowed versions")).when(
            F.col("allowed_versions") != group, F.concat(F.lit("allowed="), show(F.col("allowed_versions")))
        ),
        *[
            F.when(~F.element_at("args", F.lit(k)).eqNullSafe(F.lit(v)), F.concat(F.lit(f"{k}="), F.coalesce(F.element_at("args", F.lit(k)), F.lit("null")), F.lit(f", expected={v}")))
            for k, v in tokens.items()
        ],
        F.when(~flag("require_thinking"), F.lit("require_thinking is false")),
        F.when(~flag("filter_correct_only"), F.lit("filter_correct_only is false")),
    ]
    return F.array_compact(F.array(*errors))


def group_of_summary(prompt_versions: Column, args_versions: Column) -> Column:
    """The single listed version of a summary, else the single one of its arguments, else null."""
    listed = F.filter(F.transform(prompt_versions, strip), lambda x: x != "")
    given = F.filter(F.transform(F.split(F.coalesce(args_versions, F.lit("")), ","), strip), lambda x: x != "")
    return F.when(F.size(listed) == 1, F.get(listed, 0)).when(F.size(given) == 1, F.get(given, 0))


def run_status(
    returncode: Column, has_metrics: Column, metadata_ok: Column, tokens_ok: Column, format_failed: Column, samples: Column, expected: int,
    fail_on_metadata: bool = True, fail_on_tokens: bool = False, fail_on_format: bool = True,
) -> Column:
    """eval_failed, eval_failed_missing_metrics, validation_failed or ok."""
    hard = F.lit(False)
    if fail_on_metadata:
        hard = hard | ~metadata_ok
    if fail_on_tokens:
        hard = hard | ~tokens_ok
    if fail_on_format:
        hard = hard | format_failed
    if expected > 0:
        hard = hard | F.coalesce(samples != expected, F.lit(True))
    return (
        F.when(returncode != 0, "eval_failed").when(~has_metrics, "eval_failed_missing_metrics").when(hard, "validation_failed").otherwise("ok")
    )


def checkpoint_step(label: Column) -> Column:
    """The number of a checkpoint-<n> name; -1 otherwise."""
    base = F.regexp_extract(F.regexp_replace(label, "/+$", ""), "([^/]*)$", 1)
    return F.coalesce(F.regexp_extract(base, "^checkpoint-([0-9]+)$", 1).try_cast("long"), F.lit(-1).cast("long"))


def ranked(df: DataFrame, score: str, tie: str, descending: bool = True, name: str = "rank") -> DataFrame:
    """1-based rank of the result table (one row per run, so a single window is small); missing scores come last."""
    order = F.desc_nulls_last(score) if descending else F.asc_nulls_last(score)
    return df.withColumn(name, F.row_number().over(Window.orderBy(order, tie)))


def best_by_group(df: DataFrame, score: str, tie: str, group: str = "group") -> DataFrame:
    """The best row of status ok of each group, first in rank order."""
    others = [c for c in df.columns if c not in (score, tie, group)]
    good = df.where((F.col("status") == "ok") & F.col(score).isNotNull())
    best = good.groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("__s"), F.col(tie), *others, F.col(score))).alias("b"))
    return best.select(group, "b.*").select(*df.columns)


def best_checkpoint(evals: DataFrame, run: str = "run_name") -> DataFrame:
    """For each run the checkpoint with the highest exact match; of equals the first by ordinal."""
    order = F.struct((-F.col("exact_match")).alias("m"), F.col("ordinal"), F.col("label"), F.col("exact_match"))
    best = evals.where("exact_match IS NOT NULL").groupBy(run).agg(F.min(order).alias("b"))
    return best.select(run, F.col("b.label").alias("label"), F.col("b.exact_match").alias("exact_match"))


def eval_targets(checkpoints: DataFrame, mode: str, run: str = "run_name") -> DataFrame:
    """Checkpoints to evaluate: ``all``, the ``latest`` by step, or the ``final`` model (label "final")."""
    stepped = checkpoints.withColumn("step", checkpoint_step(F.col("label")))
    if mode == "all":
        return stepped
    if mode == "final":
        return stepped.where("label = 'final'")
    best = stepped.where("step >= 0").groupBy(run).agg(F.max(F.struct("step", "label")).alias("b"))
    return best.select(run, F.col("b.label").alias("label"), F.col("b.step").alias("step"))


def mean_group_loss(runs: DataFrame, groups: list[str]) -> DataFrame:
    """Unweighted mean over the losses that are present; null where none is."""
    cells = F.array(*[F.col(g) for g in groups])
    present = F.filter(cells, lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda n, x: n + x)
    return runs.withColumn("mean_group_loss", F.when(F.size(present) > 0, total / F.size(present)))


def pending(jobs: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Jobs without a done marker."""
    return jobs.join(finished.select(key).distinct(), key, "left_anti")


def grid(spark, axes: dict[str, list], max_runs: int = 0) -> DataFrame:
    """The Cartesian product of literal axes in order, with its ordinal; only literals meet, never data."""
    rows = spark.range(1).select(F.lit(0).cast("long").alias("ordinal"))
    for name, values in axes.items():
        rows = rows.withColumn("__v", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])))
        rows = rows.withColumn("ordinal", F.col("ordinal") * len(values) + F.col("__v.i")).withColumn(name, F.col("__v.v")).drop("__v")
    return rows.where(F.col("ordinal") < max_runs) if max_runs > 0 else rows


def axis(df: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct values of a column in order, nulls left out, for a grid; more than ``most`` are an error, as every one multiplies the runs."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return found


def missing_tokens(vocabulary: DataFrame, expected: dict[str, str], model: str = "model", token: str = "token") -> DataFrame:
    """(model, ok, missing_tokens): which of the expected special tokens a model's vocabulary lacks; a model is read once for all its jobs."""
    wanted = F.array_sort(F.array(*[F.lit(t) for t in set(expected.values())]))
    known = vocabulary.groupBy(model).agg(F.collect_set(F.when(F.col(token).isin(*expected.values()), F.col(token))).alias("__known"))
    lacking = F.array_except(wanted, F.col("__known"))
    return known.select(model, (F.size(lacking) == 0).alias("ok"), lacking.alias("missing_tokens"))


def eval_jobs(runs: DataFrame, checkpoints: DataFrame, mode: str) -> DataFrame:
    """The job table of an evaluation: (job_no, group, run_name, label, step), numbered by group, run and label from 0.

    It has a row for each checkpoint to evaluate, a result table; Spark's scheduler is the worker pool.
    """
    targets = eval_targets(checkpoints, mode)
    jobs = runs.select("run_name", "group").join(targets, "run_name")
    number = F.row_number().over(Window.orderBy("group", "run_name", "label")) - 1
    return jobs.select(number.alias("job_no"), "group", "run_name", "label", "step")


def sweep(grid_rows: DataFrame, losses: DataFrame, groups: list[str], run: str = "run_name") -> DataFrame:
    """A mixture sweep's table: each configuration with its status and mean loss, ranked; unfinished ones last."""
    done = mean_group_loss(losses, groups).select(run, "mean_group_loss", F.lit("ok").alias("status"))
    joined = grid_rows.join(done, run, "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return ranked(joined, "mean_group_loss", run, descending=False)


def group_sweep(grid_rows: DataFrame, evals: DataFrame, run: str = "run_name", group: str = "group") -> DataFrame:
    """A group sweep's table: the best checkpoint of each run, ranked, and whether it is the best of its group."""
    best = best_checkpoint(evals, run)
    table = grid_rows.join(best, run, "left").withColumn("status", F.when(F.col("label").isNull(), "pending").otherwise("ok"))
    tops = best_by_group(table.select(group, run, "exact_match", "status"), "exact_match", run, group)
    marked = table.join(tops.select(run, F.lit(True).alias("best_of_group")), run, "left")
    return ranked(marked.withColumn("best_of_group", F.coalesce("best_of_group", F.lit(False))), "exact_match", run)
