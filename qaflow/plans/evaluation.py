"""Queries over predictions, rollouts and runs; the model boundary and the sinks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from qaflow.functions import scoring
from qaflow.functions.strings import normalize_answer
from qaflow.operators import rollouts as rl
from qaflow.operators import validation
from qaflow.plans import fixtures
from qaflow.plans.fixtures import outputs, outputs_sql, predictions, rollouts, rollouts_sql, table, with_
from qaflow.registry import query
from qaflow.shared import new_path
from qaflow.sources import sinks
from qaflow.streaming import inference, pool

# RE2 has no word boundary beyond ASCII, so an article's neighbours are named; a shared blank is why it is done twice.
_ARTICLE = r"(^|[^\pL\pN_])(a|an|the)($|[^\pL\pN_])"
_DROP = rf"regexp_replace(regexp_replace({{}}, '{_ARTICLE}', '\1 \3', 'g'), '{_ARTICLE}', '\1 \3', 'g')"
_NORM = r"trim(regexp_replace(" + _DROP.format("regexp_replace(lower({}), '[[:punct:]]', '', 'g')") + r", '\s+', ' ', 'g'))"
_TOKENS = "list_filter(string_split({}, ' '), lambda x: x <> '')"

# Latin letters with marks and their decompositions, which SQL has no function for.
_MARKED = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xE0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1]


def _nfd(x: str) -> str:
    for c, parts in _MARKED:
        x = f"replace({x}, '{c}', '{parts}')"
    return x


_NORM_NFD = _NORM.replace("lower({})", _nfd("lower({})"))


def _scored_sql(norm: str) -> str:
    return (
        with_("qa", "preds")
        + f""", norm AS (SELECT conv_id, turn, type, level, {norm.format("gold")} AS g, {norm.format("prediction")} AS p FROM preds),
toks AS (SELECT *, {_TOKENS.format("g")} AS gt, {_TOKENS.format("p")} AS pt FROM norm),
overlap AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda x: x = t)), len(list_filter(gt, lambda x: x = t))))), 0)::INT AS same FROM toks),
scored AS (SELECT conv_id, turn, type, level, same, (g = p)::INT::DOUBLE AS em,
  CASE WHEN len(pt) = 0 AND len(gt) = 0 THEN 1.0::DOUBLE WHEN len(pt) = 0 OR len(gt) = 0 OR same = 0 THEN 0.0::DOUBLE
    ELSE 2 * (same::DOUBLE / len(pt)) * (same::DOUBLE / len(gt)) / ((same::DOUBLE / len(pt)) + (same::DOUBLE / len(gt))) END AS f1 FROM overlap)
"""
    )


_SCORED = _scored_sql(_NORM)


def _scored(spark, d):
    p = predictions(spark, d)
    gold, prediction = F.col("gold"), F.col("prediction")
    return p.select("conv_id", "turn", "type", "level", scoring.exact_match(prediction, gold).alias("em"), scoring.token_f1(prediction, gold).alias("f1"))


@query(_SCORED + "SELECT conv_id, turn, em, round(f1, 9) AS f1 FROM scored")
def em_f1_rows(spark, d):
    return _scored(spark, d).select("conv_id", "turn", "em", F.round("f1", 9).alias("f1"))


@query(
    _SCORED
    + """, u AS (SELECT coalesce(type, 'unknown') AS type, coalesce(level, 'unknown') AS level, em, f1 FROM scored)
SELECT CASE WHEN grouping(type) = 1 AND grouping(level) = 1 THEN 'total' WHEN grouping(level) = 1 THEN 'type' ELSE 'level' END AS kind,
  coalesce(type, level, '') AS name, count(*) AS num_samples, round(100 * sum(em) / count(*), 6) AS exact_match, round(100 * sum(f1) / count(*), 6) AS f1
FROM u GROUP BY GROUPING SETS ((), (type), (level))"""
)
def em_f1_breakdown(spark, d):
    return scoring.breakdown(_scored(spark, d))


@query(_SCORED + "SELECT conv_id, turn, same AS overlap FROM scored")
def bag_overlap(spark, d):
    tokens = lambda c: F.filter(F.split(normalize_answer(F.col(c)), " "), lambda t: t != "")
    return predictions(spark, d).select("conv_id", "turn", scoring.bag_overlap(tokens("prediction"), tokens("gold")).alias("overlap"))


@query(_scored_sql(_NORM_NFD) + "SELECT conv_id, turn, em, round(f1, 9) AS f1 FROM scored")
def em_f1_nfd(spark, d):
    p = predictions(spark, d)
    nfd = scoring.normalize_answer_nfd
    return p.select(
        "conv_id",
        "turn",
        scoring.exact_match(F.col("prediction"), F.col("gold"), nfd).alias("em"),
        F.round(scoring.token_f1(F.col("prediction"), F.col("gold"), nfd), 9).alias("f1"),
    )


_REWARDS = (
    "WITH "
    + rollouts_sql()
    + r""", m AS (SELECT group_id, turn, gold, trim(regexp_replace(regexp_replace(regexp_replace(completion, '<\|[^>]+?\|>', ' ', 'g'), '</?s>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM rolls),
f AS (SELECT *, regexp_matches(t, '^[^<]*<think>[^<]*</think>[^<]*<answer>[^<]*</answer>')::INT::DOUBLE AS format_reward, trim(regexp_extract(t, '<answer>(.*?)</answer>', 1)) AS answer FROM m),
rewards AS (SELECT group_id, turn, format_reward, CASE WHEN answer = '' THEN 0.0::DOUBLE ELSE ("""
    + _NORM.format("answer")
    + " = "
    + _NORM.format("gold")
    + r""")::INT::DOUBLE END AS em_reward FROM f),
scored AS (SELECT *, 0.2::DOUBLE * format_reward + 0.8::DOUBLE * em_reward AS reward FROM rewards),
adv AS (SELECT *, (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 0.000001::DOUBLE) AS advantage FROM scored WINDOW w AS (PARTITION BY group_id))
"""
)


def _rewarded(spark, d):
    return rl.rewards(rollouts(spark, d))


@query(_REWARDS + "SELECT group_id, turn, format_reward, em_reward, round(reward, 6) AS reward FROM scored")
def rollout_rewards(spark, d):
    return _rewarded(spark, d).select("group_id", "turn", "format_reward", "em_reward", F.round("reward", 6).alias("reward"))


@query(_REWARDS + "SELECT group_id, turn, round(advantage, 5) + 0.0 AS advantage FROM adv")
def group_advantage(spark, d):
    return rl.advantages(_rewarded(spark, d)).select("group_id", "turn", (F.round("advantage", 5) + F.lit(0.0)).alias("advantage"))


@query(
    _REWARDS
    + "SELECT round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std, round(avg(format_reward), 6) AS format_rate, round(avg(em_reward), 6) AS em_rate FROM scored"
)
def reward_stats(spark, d):
    s = rl.reward_stats(_rewarded(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(
    _REWARDS
    + """, l AS (SELECT *, -((turn * 7 + group_id) % 50)::DOUBLE / 10 AS logp, -((turn * 3 + group_id) % 40)::DOUBLE / 10 AS logp_ref FROM adv),
r AS (SELECT *, exp(least(greatest(logp - logp_ref, -20.0::DOUBLE), 20.0::DOUBLE)) AS ratio FROM l)
SELECT group_id, turn, round(advantage * logp - 0.04::DOUBLE * (logp - logp_ref), 4) + 0.0 AS grpo,
  round(least(ratio * advantage, least(greatest(ratio, 0.8::DOUBLE), 1.2::DOUBLE) * advantage) - 0.04::DOUBLE * (logp - logp_ref), 4) + 0.0 AS clipped FROM r"""
)
def policy_objective(spark, d):
    rows = rl.advantages(_rewarded(spark, d))
    logp = -F.pmod(F.col("turn") * 7 + F.col("group_id"), F.lit(50)).cast("double") / 10
    ref = -F.pmod(F.col("turn") * 3 + F.col("group_id"), F.lit(40)).cast("double") / 10
    a = F.col("advantage")
    return rows.select(
        "group_id",
        "turn",
        (F.round(rl.grpo_objective(a, logp, ref, 0.04), 4) + F.lit(0.0)).alias("grpo"),
        (F.round(rl.clipped_ratio_objective(a, logp, ref, 0.04, 0.2), 4) + F.lit(0.0)).alias("clipped"),
    )


@query("WITH " + rollouts_sql() + " SELECT group_id, turn, copy FROM rolls, range(1, 5) r(copy)")
def prompt_groups(spark, d):
    return rl.replicate(rollouts(spark, d).select("group_id", "turn"), 4).select("group_id", "turn", F.col("copy").cast("long").alias("copy"))


@query(_REWARDS + "SELECT round(avg(format_reward), 6) AS eval_format_rate, round(avg(em_reward), 6) AS eval_em_rate, round(0.2::DOUBLE * avg(format_reward) + 0.8::DOUBLE * avg(em_reward), 6) AS eval_reward FROM scored")
def eval_rates(spark, d):
    s = rl.eval_rates(_rewarded(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


_MARKERS = {k: f"[{k}]" for k in ("thinking_start", "thinking_end", "answer_start", "answer_end")}
_FORMATS = with_("qa", outputs_sql(fixtures.BRACKET_TEMPLATES)) + (
    """, g AS (SELECT prompt_version, raw_output AS r, CASE WHEN turn % 7 = 3 THEN '' ELSE query END AS th, answer AS an, CASE WHEN conv_id % 13 = 5 THEN NULL ELSE 1 END AS f1 FROM outs),
rates AS (SELECT prompt_version, count(*) AS num_rows, """
    + ", ".join(f"count(*) FILTER (contains(r, '[{k}]'))::DOUBLE / count(*) AS {k}_rate" for k in _MARKERS)
    + """, count(*) FILTER (trim(th) <> '')::DOUBLE / count(*) AS nonempty_thinking_rate, count(*) FILTER (trim(an) <> '')::DOUBLE / count(*) AS nonempty_answer_rate,
  count(*) FILTER (f1 IS NULL)::DOUBLE / count(*) AS missing_required_keys_rate FROM g GROUP BY 1)
"""
)


def _rates(spark, d):
    rows = outputs(spark, d, fixtures.BRACKET_TEMPLATES).select(
        "prompt_version",
        F.col("raw_output").alias("raw_generation"),
        F.when(F.pmod("turn", F.lit(7)) == 3, "").otherwise(F.col("query")).alias("prediction_thinking"),
        F.col("answer").alias("prediction_answer"),
        F.lit(0.0).alias("em"),
        F.when(F.pmod("conv_id", F.lit(13)) != 5, F.lit(1.0)).alias("f1"),
    )
    return validation.format_rates(rows, _MARKERS, ("prompt_version",))


@query(_FORMATS + "SELECT prompt_version, num_rows, " + ", ".join(f"round({c}, 9) AS {c}" for c in validation.RATES) + " FROM rates")
def format_rates(spark, d):
    return _rates(spark, d).select("prompt_version", "num_rows", *[F.round(c, 9).alias(c) for c in validation.RATES])


_GATES = ", ".join(
    [f"CASE WHEN {n} < {b}::DOUBLE THEN '{n}=' || printf('%.4f', {n}) || ' < {b:.4f}' END" for n, b in validation.MINIMA.items()]
    + ["CASE WHEN missing_required_keys_rate > 0 THEN 'missing_required_keys_rate=' || printf('%.4f', missing_required_keys_rate) || ' > 0.0000' END"]
)


@query(_FORMATS + f"SELECT prompt_version, array_to_string(list_filter([{_GATES}], lambda x: x IS NOT NULL), '; ') AS failures FROM rates")
def threshold_gate(spark, d):
    return _rates(spark, d).select("prompt_version", F.array_join(validation.gate_failures(), "; ").alias("failures"))


_RUNS = """WITH runs AS (SELECT o_custkey AS run, o_orderstatus AS grp, avg(o_totalprice) AS score, count(*) AS num_samples FROM orders GROUP BY 1, 2),
jobs AS (SELECT *, CASE WHEN run % 17 = 0 THEN 1 ELSE 0 END AS returncode, run % 19 <> 0 AS has_metrics, run % 5 <> 0 AS metadata_ok, run % 7 <> 0 AS tokens_ok, run % 11 = 0 AS format_failed FROM runs),
status AS (SELECT *, CASE WHEN returncode <> 0 THEN 'eval_failed' WHEN NOT has_metrics THEN 'eval_failed_missing_metrics'
  WHEN NOT metadata_ok OR format_failed OR num_samples <> 3 THEN 'validation_failed' ELSE 'ok' END AS status FROM jobs)
"""


def _status(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("grp")).agg(F.avg("o_totalprice").alias("score"), F.count("*").alias("num_samples"))
    run = F.col("run")
    status = validation.run_status(
        F.when(run % 17 == 0, 1).otherwise(0), run % 19 != 0, run % 5 != 0, run % 7 != 0, run % 11 == 0, F.col("num_samples"), 3
    )
    return runs.withColumn("status", status)


@query(_RUNS + "SELECT run, grp, status FROM status")
def run_status(spark, d):
    return _status(spark, d).select("run", "grp", "status")


@query(_RUNS + "SELECT status, count(*) AS jobs FROM status GROUP BY 1")
def status_counts(spark, d):
    return _status(spark, d).groupBy("status").agg(F.count("*").alias("jobs"))


_LOSSES = """WITH l AS (SELECT o_orderpriority AS run_name, avg(o_totalprice) FILTER (o_orderstatus = 'F') / 100000 AS f,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN avg(o_totalprice) FILTER (o_orderstatus = 'O') / 100000 END AS o, avg(o_totalprice) FILTER (o_orderstatus = 'P') / 100000 AS p FROM orders GROUP BY 1),
m AS (SELECT run_name, (SELECT avg(x) FROM unnest([f, o, p]) u(x)) AS mean_group_loss FROM l)
"""


def _losses(spark, d):
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))) / 100000
    runs = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_name")).agg(mean("F").alias("f"), mean("O").alias("o"), mean("P").alias("p"))
    runs = runs.withColumn("o", F.when(F.col("run_name") != "1-URGENT", F.col("o")))
    return validation.mean_group_loss(runs, ["f", "o", "p"])


@query(_LOSSES + "SELECT run_name, round(mean_group_loss, 9) AS mean_group_loss FROM m")
def mean_group_loss(spark, d):
    return _losses(spark, d).select("run_name", F.round("mean_group_loss", 9).alias("mean_group_loss"))


@query(_LOSSES + "SELECT run_name, row_number() OVER (ORDER BY mean_group_loss ASC NULLS LAST, run_name)::INT AS rank FROM m")
def rank_runs(spark, d):
    return validation.ranked(_losses(spark, d), "mean_group_loss", "run_name", descending=False).select("run_name", "rank")


@query(_RUNS + "SELECT grp, run, round(score, 6) AS score FROM status WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, run) = 1")
def best_by_group(spark, d):
    best = validation.best_by_group(_status(spark, d), "score", "run", "grp")
    return best.select("grp", "run", F.round("score", 6).alias("score"))


_EVALS = """WITH e AS (SELECT l_orderkey % 40 AS run_name, 'checkpoint-' || (l_linenumber * 100) AS label, l_linenumber AS ordinal, round(avg(l_quantity), 0) AS em FROM lineitem GROUP BY ALL)
"""


def _evals(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(40)).alias("run_name"), F.col("l_linenumber").alias("ordinal")).agg(F.round(F.avg("l_quantity"), 0).alias("exact_match"))
    return rows.withColumn("label", F.concat(F.lit("checkpoint-"), (F.col("ordinal") * 100).cast("string")))


@query(_EVALS + "SELECT run_name, label, em AS exact_match FROM e QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY em DESC, ordinal) = 1")
def best_checkpoint(spark, d):
    return validation.best_checkpoint(_evals(spark, d))


@query(_EVALS + "SELECT run_name, arg_max(label, ordinal) AS label, max(ordinal)::BIGINT * 100 AS step FROM e GROUP BY 1")
def latest_checkpoints(spark, d):
    return validation.eval_targets(_evals(spark, d), "latest")


@query(
    """WITH lr AS (SELECT DISTINCT round(l_discount * 0.001, 5) AS lr FROM lineitem), mix AS (SELECT DISTINCT lang AS mix FROM documents WHERE lang IS NOT NULL), epochs AS (SELECT DISTINCT l_linenumber::INT AS epochs FROM lineitem)
SELECT row_number() OVER (ORDER BY lr, mix, epochs) - 1 AS ordinal, lr, mix, epochs FROM lr, mix, epochs ORDER BY 1 LIMIT 150"""
)
def hyper_grid(spark, d):
    """The first 150 runs of a grid whose axes are the few distinct values of three columns."""
    lines = table(spark, d, "lineitem")
    axes = {"lr": lines.select(F.round(F.col("l_discount") * 0.001, 5).alias("v")), "mix": table(spark, d, "documents").select(F.col("lang").alias("v")), "epochs": lines.select(F.col("l_linenumber").cast("int").alias("v"))}
    return validation.grid(spark, {name: validation.axis(df, "v") for name, df in axes.items()}, 150)


@query(
    with_("qa")
    + r"""SELECT conv_id, turn, '<think>' || array_to_string(list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '')[1:8], ' ') || '</think><answer>' ||
  list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '')[-1] || '</answer>' AS raw_output FROM qa"""
)
def stub_inference(spark, d):
    return inference.infer(fixtures.qa_pairs(spark, d), "query").select("conv_id", "turn", "raw_output")


@query("SELECT conv_id, turn, query, answer FROM qa".join([with_("qa"), ""]))
def sharded_write_roundtrip(spark, d):
    path = new_path(spark, "shards")
    rows = fixtures.qa_pairs(spark, d)
    sinks.write_shards(rows, path, 100)
    return spark.read.schema(rows.schema).parquet(path)


@query(
    """WITH r AS (SELECT (event_id % 8)::INT AS lane, event_id, row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) - 1 AS n FROM events),
p AS (SELECT *, least(n, 64) AS size, ('0x' || substr(md5(event_id || ':3'), 1, 8))::BIGINT AS h FROM r)
SELECT p.lane, p.event_id, o.event_id AS partner_id, p.size::INT AS pool_size FROM p JOIN r o ON o.lane = p.lane AND o.n = p.n - p.size + p.h % p.size WHERE p.n >= 4"""
)
def streaming_pool(spark, d):
    events = table(spark, d, "events")
    at = new_path(spark, "pool")
    return pool.run_pool(spark, f"{d}/events.parquet*", events.schema, f"{at}/out", f"{at}/checkpoint", lanes=8)
