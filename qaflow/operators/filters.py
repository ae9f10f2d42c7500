"""Row filters with stage counts, and label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.functions.parsers import think_text
from qaflow.functions.strings import strip, strip_meta, words
from qaflow.schemas import require_columns


def non_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all non-blank; array columns must have items."""
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        df = df.where(F.size(c) > 0 if kind == "array" else strip(F.col(c)) != "")
    return df


def quality_stages(require_thinking: bool = True, correct_only: bool = True, require_parse_ok: bool = False) -> list[tuple[str, Column]]:
    """The ordered conditions of the quality filter."""
    filled = (strip(F.col("query")) != "") & (strip(F.col("context")) != "") & (strip(F.col("answer")) != "")
    stages = [("non_empty", filled)]
    if require_thinking:
        stages.append(("thinking", strip(F.col("thinking")) != ""))
    if correct_only:
        stages.append(("correct", strip(F.col("reference_answer")) == strip(F.col("answer"))))
    if require_parse_ok:
        stages.append(("parse_ok", F.coalesce(F.col("parse_ok"), F.lit(False))))
    return stages


def quality_filter(df: DataFrame, **options) -> DataFrame:
    for _, condition in quality_stages(**options):
        df = df.where(condition)
    return df


def stage_counts(df: DataFrame, **options) -> DataFrame:
    """Rows before the filter and after each stage, in one pass: (stage_no, stage, rows)."""
    passed, named = F.lit(True), [("before", F.lit(True))]
    for name, condition in quality_stages(**options):
        passed = passed & F.coalesce(condition, F.lit(False))
        named.append((f"after_{name}", passed))
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in named])
    cells = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.col(n).alias("rows")) for i, (n, _) in enumerate(named)])
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def prompt_versions(df: DataFrame, versions: list[str]) -> DataFrame:
    """Rows of the listed versions; an empty list keeps all."""
    return df.where(F.col("prompt_version").isin(*versions)) if versions else df


def reasoning_fields(df: DataFrame, source: str = "raw_output_think", fallback: bool = True) -> DataFrame:
    """``thinking`` from the raw output's think span or from its column, with the column as fallback; ``answer`` stripped."""
    require_columns(df, ["answer"] + ["raw_output"] * (source == "raw_output_think") + ["thinking"] * (fallback or source == "thinking"))
    column = strip_meta(strip(F.col("thinking"))) if "thinking" in df.columns else F.lit("")
    raw = think_text(F.col("raw_output")) if "raw_output" in df.columns else F.lit("")
    chosen = column if source == "thinking" else F.coalesce(F.nullif(raw, F.lit("")), column if fallback else F.lit(""))
    return df.withColumns({"thinking": chosen, "answer": strip(F.col("answer")), "has_raw_think": raw != "", "has_thinking": chosen != ""})


def short_enough(df: DataFrame, prompt: Column, max_len: int, min_target: int | None = None, tokens=words) -> DataFrame:
    """Rows whose prompt leaves room for the target; counts saturate at ``max_len`` as a truncating tokenizer's do."""
    n = F.least(F.size(tokens(prompt)), F.lit(max_len))
    return df.where(n < (max_len - 1 if min_target is None else max_len - max(1, min_target)))


def masked_labels(ids: Column, mask: Column, prompt_len: Column) -> Column:
    """-100 for the prompt's tokens (all of them where the prompt fills the row) and for padding; else the token."""
    return F.transform(ids, lambda t, i: F.when((i < prompt_len) | (F.get(mask, i) == 0), F.lit(-100)).otherwise(t))
