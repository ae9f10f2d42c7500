"""Queries over grounded question-answer rows: validity, splits, mixtures, samples, jobs and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaflow.functions.strings import strip, truncate_chars
from qaflow.operators import membership, mixing, sampling, splits, synth, tasks
from qaflow.plans.fixtures import classed_qa, grounded_qa, qa_pairs, table, with_
from qaflow.registry import query
from qaflow.shared import write_once

KEYS = ["conv_id", "turn"]
RATIOS = {"correct": 0.70, "refusal": 0.15, "negative": 0.15}
CLASSED = with_("qa", "grounded", "classed")
_RANK = "row_number() OVER ({part} ORDER BY md5(concat_ws(':', {keys}, '{seed}')), {keys})"


def _rank(seed: int, keys: str = "conv_id, turn", part: str = "") -> str:
    return _RANK.format(seed=seed, keys=keys, part=f"PARTITION BY {part}" if part else "")


def _u(expr: str, digits: int = 8) -> str:
    """The hashed integer of an md5 over a text expression."""
    return f"('0x' || substr(md5({expr}), 1, {digits}))::BIGINT"


@query(
    r"""WITH n AS (SELECT count(*) AS n FROM benchmark),
rows AS (SELECT d.doc_id, d.lang, regexp_replace(b.text, '^\s+|\s+$', '', 'g') AS q, regexp_replace(d.text, '^\s+|\s+$', '', 'g') AS c
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT n FROM n))
SELECT doc_id, q AS query, length(regexp_replace(substr(c, 1, 6000), '\s+$', ''))::BIGINT AS context_chars, md5(regexp_replace(substr(c, 1, 6000), '\s+$', '')) AS context_md5
FROM rows WHERE lang = 'en' AND q <> '' AND length(q) <= 512 AND length(c) >= 300 AND length(c) <= 60000"""
)
def corpus_valid_rows(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    n = items.count()
    rows = docs.withColumn("item_id", F.pmod("doc_id", F.lit(n))).join(items.select("item_id", F.col("text").alias("query")), "item_id")
    named = rows.select("doc_id", F.col("lang").alias("language"), "query", F.col("text").alias("query_seed_text"))
    context = truncate_chars(F.col("query_seed_text"), 6000)
    return synth.valid_rows(named).select(
        "doc_id", strip(F.col("query")).alias("query"), F.length(context).cast("long").alias("context_chars"), F.md5(context.cast("binary")).alias("context_md5")
    )


@query(
    with_("qa", "grounded", "classed")
    + """SELECT example_type, count(*) AS seen, count(*) FILTER (query <> '' AND answer <> '') AS kept,
  count(*) FILTER (NOT (query <> '' AND answer <> '')) AS dropped FROM everything GROUP BY 1"""
)
def split_class_counts(spark, d):
    return splits.class_counts(grounded_qa(spark, d))


@query(CLASSED + "SELECT conv_id, turn, query, md5(context) AS context_md5, answer, negative, example_type FROM classed")
def split_rows(spark, d):
    return classed_qa(spark, d).select("conv_id", "turn", "query", F.md5(F.col("context").cast("binary")).alias("context_md5"), "answer", "negative", "example_type")


_STRATIFIED = CLASSED + f", split AS (SELECT *, CASE WHEN {_rank(13, part='example_type')} <= 20 THEN 'validation' ELSE 'train' END AS split FROM classed)\n"


@query(_STRATIFIED + "SELECT conv_id, turn, example_type, split FROM split")
def split_stratified(spark, d):
    return splits.stratified(grounded_qa(spark, d), KEYS, 20, 13).select("conv_id", "turn", "example_type", "split")


@query(
    _STRATIFIED
    + "SELECT example_type, count(*) AS kept, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'train') AS train FROM split GROUP BY 1"
)
def split_stats(spark, d):
    return splits.split_stats(splits.stratified(grounded_qa(spark, d), KEYS, 20, 13))


def _mixed(df):
    return df.select("conv_id", "turn", "example_type", F.col("draw").cast("long").alias("draw"))


@query(CLASSED + f"SELECT conv_id, turn, example_type, {_rank(21)} AS draw FROM classed QUALIFY draw <= 100")
def mix_natural(spark, d):
    return _mixed(mixing.mix(classed_qa(spark, d), KEYS, "natural", 21, target=100))


_RANKED = CLASSED + f", ranked AS (SELECT *, {_rank(21, part='example_type')} AS draw FROM classed)\n"


@query(_RANKED + "SELECT conv_id, turn, example_type, draw FROM ranked WHERE draw <= (SELECT min(n) FROM (SELECT count(*) AS n FROM classed GROUP BY example_type))")
def mix_balanced(spark, d):
    return _mixed(mixing.mix(classed_qa(spark, d), KEYS, "balanced", 21))


@query(_RANKED + "SELECT conv_id, turn, example_type, draw FROM ranked WHERE draw <= CASE example_type WHEN 'negative' THEN 33 ELSE 34 END")
def mix_balanced_target(spark, d):
    return _mixed(mixing.mix(classed_qa(spark, d), KEYS, "balanced", 21, target=101))


@query(
    _RANKED
    + f""", sizes AS (SELECT example_type, count(*) AS n FROM classed GROUP BY 1), draws AS (SELECT example_type, n, i FROM sizes, unnest(range(1, (SELECT max(n) FROM sizes) + 1)) d(i))
SELECT r.conv_id, r.turn, r.example_type, i AS draw FROM draws JOIN ranked r ON r.example_type = draws.example_type
  AND r.draw = {_u("concat_ws(':', draws.example_type, i, '21')", 15)} % n + 1"""
)
def mix_balanced_oversample(spark, d):
    return _mixed(mixing.mix(classed_qa(spark, d), KEYS, "balanced", 21, oversample=True))


@query(_RANKED + "SELECT conv_id, turn, example_type, draw FROM ranked WHERE draw <= CASE example_type WHEN 'correct' THEN 63 WHEN 'refusal' THEN 14 ELSE 13 END")
def mix_custom(spark, d):
    return _mixed(mixing.mix(classed_qa(spark, d), KEYS, "custom", 21, ratios=RATIOS, target=90))


@query(
    _RANKED
    + f""", sizes AS (SELECT example_type, count(*) AS n FROM classed GROUP BY 1),
draws AS (SELECT example_type, n, unnest(range(1, CASE example_type WHEN 'correct' THEN 71 ELSE 16 END)) AS i FROM sizes)
SELECT r.conv_id, r.turn, r.example_type, i AS draw FROM draws JOIN ranked r ON r.example_type = draws.example_type
  AND r.draw = {_u("concat_ws(':', draws.example_type, i, '21')", 15)} % n + 1"""
)
def mix_oversample(spark, d):
    return _mixed(mixing.mix(classed_qa(spark, d), KEYS, "custom", 21, ratios=RATIOS, target=100, oversample=True))


@query(
    CLASSED
    + """, c AS (SELECT example_type, count(*) AS n FROM classed GROUP BY 1),
r(mixture, example_type, ratio) AS (VALUES ('a', 'correct', 0.70::DOUBLE), ('a', 'refusal', 0.15::DOUBLE), ('a', 'negative', 0.15::DOUBLE),
  ('b', 'correct', 0.50::DOUBLE), ('b', 'refusal', 0.25::DOUBLE), ('b', 'negative', 0.25::DOUBLE)),
f AS (SELECT mixture, floor(min(coalesce(n, 0) / ratio))::BIGINT AS feasible FROM r LEFT JOIN c USING (example_type) GROUP BY 1)
SELECT mixture, feasible, least(greatest(floor((SELECT min(feasible) FROM f) * 0.5::DOUBLE), 1), 800000)::BIGINT AS target FROM f"""
)
def mix_feasible_target(spark, d):
    mixtures = {"a": RATIOS, "b": {"correct": 0.5, "refusal": 0.25, "negative": 0.25}}
    return mixing.feasible_target(classed_qa(spark, d), mixtures, 0.5, 800_000)


@query(
    CLASSED
    + """SELECT example_type, count(*) AS available, CASE example_type WHEN 'correct' THEN 63 WHEN 'refusal' THEN 14 ELSE 13 END::BIGINT AS requested,
  least(count(*), CASE example_type WHEN 'correct' THEN 63 WHEN 'refusal' THEN 14 ELSE 13 END)::BIGINT AS selected FROM classed GROUP BY 1"""
)
def mix_allocation(spark, d):
    return mixing.selection_report(classed_qa(spark, d), KEYS, mixing.allocate(90, RATIOS), 21)


@query("SELECT doc_id, source FROM documents ORDER BY md5(concat_ws(':', doc_id, '4')), doc_id LIMIT 100")
def cap_shuffle(spark, d):
    return sampling.cap(table(spark, d, "documents"), ["doc_id"], 100, 4).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def first_n(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(50)


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, CASE WHEN {_rank(6, 'doc_id')} <= least(greatest(1, (SELECT floor(n * 0.1::DOUBLE) FROM n)), (SELECT n - 1 FROM n)) THEN 'eval' ELSE 'train' END AS split FROM documents"""
)
def ratio_split(spark, d):
    return sampling.ratio_split(table(spark, d, "documents").select("doc_id"), ["doc_id"], 0.1, 6)


@query(f"SELECT doc_id, source FROM documents WHERE {_u(chr(99) + 'oncat_ws(' + chr(39) + ':' + chr(39) + ', doc_id, ' + chr(39) + '8' + chr(39) + ')')} / 4294967296::DOUBLE < 0.3::DOUBLE")
def bernoulli_sample(spark, d):
    return sampling.bernoulli(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 0.3, 8)


@query(f"SELECT doc_id, (({_rank(9, 'doc_id')} - 1) % 8)::INT AS worker FROM documents")
def worker_round_robin(spark, d):
    return sampling.round_robin(table(spark, d, "documents").select("doc_id"), ["doc_id"], 8, 9)


@query("SELECT i::INT AS worker, (n // 8 + CASE WHEN i < n % 8 THEN 1 ELSE 0 END)::BIGINT AS target FROM (SELECT count(*) AS n FROM documents), range(8) r(i)")
def local_targets(spark, d):
    return sampling.local_targets(spark, table(spark, d, "documents").count(), 8)


_STREAM = "WITH rows AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)"
_PICKS = (
    _STREAM
    + f""", picks AS (SELECT doc_id, source, k, rn - 1 - {_u("concat_ws(':', doc_id, k, '11')")} % least(rn - 1, 4096) AS prn
  FROM rows, range(11) r(k) WHERE rn > 256 AND {_u("concat_ws(':', doc_id, '11:draw')")} / 4294967296::DOUBLE < 0.3::DOUBLE),
chosen AS (SELECT p.doc_id, o.doc_id AS partner_key, o.source AS partner_url, CASE WHEN o.source <> p.source THEN k ELSE 1000 - k END AS pref
  FROM picks p JOIN rows o ON o.rn = p.prn QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY pref) = 1)
"""
)


def _mismatched(spark, d):
    return synth.mismatched(table(spark, d, "documents"), "doc_id", "source", "text", p=0.3)


@query(_PICKS + "SELECT doc_id, partner_key, partner_url FROM chosen")
def mismatched_context(spark, d):
    return _mismatched(spark, d)


_MISSING = f"""hits AS (SELECT doc_id FROM documents WHERE {_u("concat_ws(':', doc_id, '31')")} / 4294967296::DOUBLE < 0.05::DOUBLE ORDER BY doc_id LIMIT 20)"""


@query("WITH " + _MISSING + " SELECT doc_id FROM hits")
def capped_missing_context(spark, d):
    return synth.capped_hits(table(spark, d, "documents").select("doc_id"), "doc_id", 0.05, 20, 31).select("doc_id")


@query(
    _PICKS
    + ", "
    + _MISSING
    + r""", jobs AS (
  SELECT doc_id AS key, 'missing' AS kind, '' AS context, true AS is_negative, false AS needs_infer, 'i dont see any relevant context.' AS answer FROM hits
  UNION ALL SELECT doc_id, 'positive', regexp_replace(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 6000), '\s+$', ''), false, true, '' FROM documents
  UNION ALL SELECT c.doc_id, 'mismatched', regexp_replace(substr(regexp_replace(d.text, '^\s+|\s+$', '', 'g'), 1, 6000), '\s+$', ''), true, false, 'I can''t find the answer in the context'
    FROM chosen c JOIN documents d ON d.doc_id = c.partner_key)
SELECT key, kind, md5(context) AS context_md5, is_negative, needs_infer, answer FROM jobs"""
)
def fanout_jobs(spark, d):
    docs = table(spark, d, "documents")
    partners = _mismatched(spark, d).join(docs.select(F.col("doc_id").alias("partner_key"), F.col("text").alias("partner")), "partner_key").select("doc_id", "partner")
    hits = synth.capped_hits(docs.select("doc_id"), "doc_id", 0.05, 20, 31).select("doc_id", F.lit(True).alias("missing"))
    rows = docs.join(partners, "doc_id", "left").join(hits, "doc_id", "left")
    named = rows.select(F.col("doc_id").alias("key"), F.lit("q").alias("query"), F.col("text").alias("context"), "partner", "missing")
    jobs = synth.fan_out(named, F.coalesce("missing", F.lit(False)), F.col("partner"))
    return jobs.select("key", "kind", F.md5(F.col("context").cast("binary")).alias("context_md5"), "is_negative", "needs_infer", "answer")


@query(
    _STREAM
    + """SELECT doc_id, least(rn - 1, 300)::BIGINT AS pool_size, min(doc_id) OVER w AS oldest, max(doc_id) OVER w AS newest
FROM rows WINDOW w AS (ORDER BY rn ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING)"""
)
def preceding_pool(spark, d):
    return synth.preceding_pool(table(spark, d, "documents").select("doc_id"), "doc_id", 300)


@query(
    with_("qa")
    + """, n AS (SELECT count(*) AS n FROM qa), quota AS (SELECT round_even((SELECT count(*) FROM documents) * 0.7::DOUBLE, 0)::BIGINT AS q),
rows AS (SELECT conv_id, turn, e AS epoch, row_number() OVER (PARTITION BY e ORDER BY md5(concat_ws(':', e, conv_id, turn, '17')), conv_id, turn) + e * (SELECT n FROM n) AS pos
  FROM qa, range(0, (SELECT ceil(q::DOUBLE / n)::BIGINT FROM quota, n)) r(e))
SELECT conv_id, turn, epoch::INT AS epoch, pos::BIGINT AS pos FROM rows WHERE pos <= (SELECT q FROM quota)"""
)
def source_quota_cycle(spark, d):
    quota = sampling.bankers_quota(table(spark, d, "documents").count(), 0.7)
    return sampling.cycled_quota(qa_pairs(spark, d).select(*KEYS), KEYS, quota, 17).select("conv_id", "turn", F.col("epoch").cast("int").alias("epoch"), F.col("pos").cast("long").alias("pos"))


@query(
    with_("qa", "grounded")
    + r""", q AS (SELECT conv_id, turn, answer, context, CASE (conv_id + turn) % 4 WHEN 0 THEN [substr(context, 5, 20)] WHEN 1 THEN [substr(context, 1, 10), 'not in there at all']
  WHEN 2 THEN []::VARCHAR[] ELSE ['  '] END AS quotes FROM grounded)
SELECT conv_id, turn FROM q WHERE trim(answer) IN ('I don''t know', 'i dont see any relevant context.')
  OR (len(quotes) > 0 AND len(list_filter(quotes, lambda x: trim(x) <> '' AND contains(context, x))) = len(quotes))"""
)
def quote_grounding(spark, d):
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    quotes = (
        F.when(k == 0, F.array(F.substring("context", 5, 20)))
        .when(k == 1, F.array(F.substring("context", 1, 10), F.lit("not in there at all")))
        .when(k == 2, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("  ")))
    )
    rows = grounded_qa(spark, d).withColumn("quotes", quotes)
    return rows.where(synth.grounded(F.col("answer"), F.col("quotes"), F.col("context"), "I don't know")).select(*KEYS)


_TASKS = with_("qa", "grounded") + """, versions AS (SELECT g.*, 'v' || v AS prompt_version FROM grounded g, range(1, 4) r(v)),
tasks AS (SELECT conv_id, turn, query, context, answer AS reference_answer, prompt_version,
  sha256(query || chr(31) || context || chr(31) || answer || chr(31) || prompt_version || chr(31)) AS task_key FROM versions),
done AS (SELECT * FROM tasks WHERE (conv_id * 7 + turn) % 3 = 0)
"""


def _tasks(spark, d):
    rows = grounded_qa(spark, d).withColumnRenamed("answer", "reference_answer")
    return tasks.with_key(tasks.fan_out_versions(rows, KEYS)).withColumn("ord", F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 20, "0"), F.lpad(F.col("turn").cast("string"), 20, "0")))


def _done(rows):
    return rows.where(F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(3)) == 0)


@query(_TASKS + "SELECT conv_id, turn, prompt_version, task_key FROM tasks")
def task_keys(spark, d):
    return _tasks(spark, d).select("conv_id", "turn", "prompt_version", "task_key")


@query(_TASKS + "SELECT conv_id, turn, prompt_version, 32 AS key_chars, min(lpad(conv_id::VARCHAR, 20, '0') || ':' || lpad(turn::VARCHAR, 20, '0')) OVER (PARTITION BY task_key) AS first FROM tasks")
def compat_task_keys(spark, d):
    """The same tasks under keys of 128-bit BLAKE2, which SQL lacks: what SQL can say is which tasks share one. The values are tested against Python's."""
    keyed = _tasks(spark, d).select("conv_id", "turn", "prompt_version", "ord", tasks.compat_task_key(*[F.col(c) for c in tasks.KEY_PARTS]).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("ord").alias("first"))
    return keyed.join(firsts, "key").select("conv_id", "turn", "prompt_version", F.length("key").alias("key_chars"), "first")


@query(
    with_("qa", "grounded")
    + f"""SELECT conv_id, turn, 'v' || ({_u("concat_ws(':', conv_id, turn, '5')")} % 3 + 1) AS prompt_version FROM grounded"""
)
def version_fanout(spark, d):
    return tasks.fan_out_versions(grounded_qa(spark, d), KEYS, "mix").select("conv_id", "turn", "prompt_version")


@query(
    _TASKS
    + """SELECT count(*) AS rows, count(DISTINCT task_key) AS distinct_keys, count(DISTINCT task_key) FILTER (prompt_version = 'v1') AS keys_v1,
  count(DISTINCT task_key) FILTER (prompt_version = 'v2') AS keys_v2, count(DISTINCT task_key) FILTER (prompt_version = 'v3') AS keys_v3 FROM done"""
)
def completed_scan(spark, d):
    return tasks.completed_scan(_done(_tasks(spark, d)).drop("task_key")).select(F.col("rows").cast("long").alias("rows"), "distinct_keys", "keys_v1", "keys_v2", "keys_v3")


_PLANNED = _TASKS + ", missing AS (SELECT DISTINCT task_key FROM tasks WHERE task_key NOT IN (SELECT task_key FROM done)),\nplanned AS (SELECT task_key, ((row_number() OVER (ORDER BY md5(task_key || ':41'), task_key) - 1) % 8)::INT AS worker FROM missing)\n"


def _planned(spark, d):
    rows = _tasks(spark, d)
    return tasks.plan(rows, _done(rows), "ord", 8, 41)


@query(_PLANNED + "SELECT task_key, worker FROM planned")
def missing_tasks(spark, d):
    return _planned(spark, d).select("task_key", "worker")


@query(_PLANNED + "SELECT i::INT AS worker, count(task_key) AS missing FROM range(8) r(i) LEFT JOIN planned ON worker = i GROUP BY 1")
def missing_by_worker(spark, d):
    return tasks.by_worker(_planned(spark, d), 8)


@query(_TASKS + "SELECT DISTINCT task_key FROM tasks WHERE task_key NOT IN (SELECT task_key FROM done)")
def missing_tasks_filtered(spark, d):
    """The missing tasks by a Bloom filter over the finished keys, so that only its hits are shuffled to the exact anti join."""
    rows = write_once(_tasks(spark, d).select("task_key"), "task-keys")
    done = write_once(_done(_tasks(spark, d)).select("task_key"), "done-keys")
    return membership.anti_join(rows, done, "task_key").distinct()
