"""Explicit schemas of the logical tables; nothing is inferred on a production path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_DDL: dict[str, str] = {}
_MADE: dict[str, T.StructType] = {}


def __getattr__(name: str) -> T.StructType:
    """Schemas are parsed on first use, since Spark parses DDL only once there is a session."""
    if name not in _DDL:
        raise AttributeError(name)
    if name not in _MADE:
        _MADE[name] = T.StructType.fromDDL(_DDL[name])
    return _MADE[name]


_DDL["CORPUS"] = ("language string, query string, query_seed_text string, query_seed_url string, seed_license string, synth_id string")
_DDL["MULTIHOP"] = (
    "id string, question string, answer string, type string, level string, "
    "context struct<title:array<string>,sentences:array<array<string>>>, "
    "supporting_facts struct<title:array<string>,sent_id:array<int>>"
)
_DDL["JOB"] = (
    "synth_id string, query_seed_url string, seed_license string, query string, context string, is_negative boolean, "
    "is_missing_context boolean, needs_infer boolean, prompt_text string, answer string, quotes array<string>"
)
_DDL["GROUNDED_QA"] = ("negative boolean, query string, context string, answer string")
_DDL["SPLIT_ROW"] = ("query string, context string, answer string, negative boolean, example_type string")
_DDL["TRACE"] = ("query string, context string, thinking string, answer string, source string, reference_answer string")
_DDL["HOP_TRACE"] = (
    "query string, context string, thinking string, answer string, prompt_version string, reference_answer string, "
    "raw_output string, parse_ok boolean, parse_method string"
)
_DDL["TASK"] = ("query string, context string, reference_answer string, prompt_version string, task_key string")
_DDL["PARSE_FAILURE"] = (
    "reason string, query string, context string, reference_answer string, prompt_version string, parse_method string, "
    "raw_output string, parsed_thinking string, parsed_answer string"
)
_DDL["NATIVE_ROW"] = (
    "query string, context string, reference_answer string, thinking string, answer string, parse_ok boolean, parse_method string, raw_output string"
)
_DDL["ANSWER_SFT"] = ("question string, answer string, passages array<string>, source_split string")
_DDL["PREDICTION"] = (
    "id string, question string, gold_answer string, prediction string, em double, f1 double, type string, level string, "
    "context_chars int, context_mode string"
)
_DDL["REASONED_PREDICTION"] = (
    "id string, question string, gold_answer string, prediction_answer string, prediction_thinking string, raw_generation string, "
    "em double, f1 double, type string, level string, context_chars int, context_mode string"
)
_DDL["METRICS"] = ("num_samples long, exact_match double, f1 double, by_type map<string,struct<count:long,em:double,f1:double>>, by_level map<string,struct<count:long,em:double,f1:double>>")
_DDL["ROLLOUT"] = ("prompt string, completion string, reward double, format_reward double, em_reward double, group_id long")
_DDL["RL_HISTORY"] = ("step long, loss double, reward_mean double, reward_std double, format_rate double, em_rate double, mean_kl_proxy double")
_DDL["SWEEP_RESULT"] = ("run_name string, run_dir string, config map<string,string>, status string, losses map<string,double>, mean_group_loss double")
_DDL["GROUP_SWEEP_RESULT"] = (
    "run_name string, run_dir string, config map<string,string>, "
    "eval_results array<struct<label:string,exact_match:double,f1:double>>, best_checkpoint struct<label:string,exact_match:double,f1:double>, status string"
)
_DDL["VALIDATION_RESULT"] = (
    "job_idx int, gpu_id int, `group` string, run_name string, checkpoint_label string, exact_match double, f1 double, num_samples long, "
    "validation_failures array<string>, status string"
)
_DDL["RESUME_STATE"] = ("rows_seen long, written long, neg_pool array<struct<context:string,url:string>>, missing_context_written long")
_DDL["SPLIT_STATS"] = ("example_type string, seen long, kept long, validation long, train long")


def require_columns(df: DataFrame, needed: list[str], name: str = "input") -> DataFrame:
    """The frame itself, or ``ValueError`` naming the missing columns."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing columns {missing}; it has {df.columns}")
    return df
