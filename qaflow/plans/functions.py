"""Queries over scalar functions, set operations and small result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaflow.functions import docs as nested
from qaflow.functions import strings as S
from qaflow.operators import filters, tasks, validation
from qaflow.plans import fixtures
from qaflow.plans.contexts import _CONTENT, _FIELD, _META, _STRIP, _TRACES, _final_sql, _traces
from qaflow.plans.fixtures import multihop, outputs, outputs_sql, qa_pairs, table, with_
from qaflow.registry import query
from qaflow.sources import readers, sinks

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(
    rf"""SELECT doc_id, md5({_STRIP.format("text")}) AS strip_md5, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapse_md5,
  CASE WHEN length({_STRIP.format("text")}) <= 100 THEN {_STRIP.format("text")} ELSE regexp_replace(substr({_STRIP.format("text")}, 1, 100), '\s+$', '') END AS head_chars,
  array_to_string({_WORDS}[1:20], ' ') AS head_words, len({_WORDS})::BIGINT AS n_words,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '')[-1] AS last_line FROM documents"""
)
def text_functions(spark, d):
    t = F.col("text")
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, d, "documents").select(
        "doc_id",
        md5(S.strip(t)).alias("strip_md5"),
        md5(S.collapse(t)).alias("collapse_md5"),
        S.truncate_chars(t, 100).alias("head_chars"),
        S.truncate_words(t, 20).alias("head_words"),
        F.size(S.words(t)).cast("long").alias("n_words"),
        S.last_line(t).alias("last_line"),
    )


@query(with_("qa", outputs_sql(fixtures.CASCADE_TEMPLATES)) + "SELECT conv_id, turn, " + _META.format("raw_output") + " AS plain, " + _CONTENT.format("raw_output") + " AS content FROM outs")
def meta_token_cleaning(spark, d):
    rows = outputs(spark, d, fixtures.CASCADE_TEMPLATES)
    return rows.select("conv_id", "turn", S.strip_meta(F.col("raw_output")).alias("plain"), S.clean_content(F.col("raw_output"), bold=False).alias("content"))


_SPELLINGS = ["I don't know", " I DONT  know ", "Not found in the context", "i dont see any relevant context", "No relevant context", "I can't find the answer in the context.", "Paris", ""]
_VALUES = ", ".join(f"({i}, '{s.replace(chr(39), chr(39) * 2)}')" for i, s in enumerate(_SPELLINGS))


@query(
    with_("qa")
    + f""", v(i, s) AS (VALUES {_VALUES}), x AS (SELECT conv_id, turn, s FROM qa JOIN v ON i = (conv_id + turn) % {len(_SPELLINGS)})
SELECT conv_id, turn, CASE WHEN trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) IN ('i don''t know', 'i dont know', 'not found in the context') THEN 'I don''t know'
  WHEN trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) IN ('i dont see any relevant context', 'no relevant context') THEN 'i dont see any relevant context.' ELSE trim(s) END AS answer FROM x"""
)
def canonical_answers(spark, d):
    spelled = F.get(F.array(*map(F.lit, _SPELLINGS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_SPELLINGS))).cast("int"))
    return qa_pairs(spark, d).select("conv_id", "turn", S.canonical_answer(spelled).alias("answer"))


@query(
    """SELECT event_id, value <> 0 AS from_number, lower(trim(event_type)) IN ('1', 'true', 't', 'yes', 'y') AS from_text,
  CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE false END AS from_mixed FROM events"""
)
def bool_coercion(spark, d):
    mixed = F.when(F.pmod("event_id", F.lit(3)) == 0, " Yes").when(F.pmod("event_id", F.lit(3)) == 1, "no")
    return table(spark, d, "events").select(
        "event_id",
        S.to_bool(F.col("value"), "double").alias("from_number"),
        S.to_bool(F.col("event_type"), "string").alias("from_text"),
        S.to_bool(mixed, "string").alias("from_mixed"),
    )


@query(
    "SELECT o_orderkey, translate('lr' || (o_orderkey % 7)::VARCHAR || '.5e-' || (o_orderkey % 9)::VARCHAR, '.-', 'pm') AS run_name, string_split(o_orderpriority, '-')[1] AS first_item FROM orders"
)
def run_names(spark, d):
    spec = F.concat(F.lit("lr"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".5e-"), (F.col("o_orderkey") % 9).cast("string"))
    items = S.csv_items(F.translate("o_orderpriority", "-", ","))
    return table(spark, d, "orders").select("o_orderkey", S.run_name_number(spec).alias("run_name"), F.get(items, 0).alias("first_item"))


@query(
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(u, '/+$', ''), '/?[^/]*[.]parquet$', ''), '[.]rank[0-9]+$', '') AS dir
FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/part-0.parquet' WHEN 1 THEN '.rank12' ELSE '//' END AS u FROM pages)"""
)
def output_dirs(spark, d):
    k = F.pmod("page_id", F.lit(3))
    path = F.concat("url", F.when(k == 0, "/part-0.parquet").when(k == 1, ".rank12").otherwise("//"))
    return table(spark, d, "pages").select("page_id", S.output_dir(path).alias("dir"))


@query(
    with_("qa", outputs_sql(fixtures.TAG_TEMPLATES))
    + "SELECT conv_id, turn, trim(answer) <> '' AND contains(lower("
    + _META.format("raw_output")
    + "), lower(trim(answer))) AS found FROM outs"
)
def answer_containment(spark, d):
    rows = outputs(spark, d, fixtures.TAG_TEMPLATES)
    return rows.select("conv_id", "turn", S.contains_answer(F.col("raw_output"), F.col("answer")).alias("found"))


@query("SELECT doc_id AS id, lang, NULL::BIGINT AS page_id FROM documents UNION ALL SELECT NULL, NULL, page_id FROM pages")
def union_rows(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return readers.union_all(docs, table(spark, d, "pages").select("page_id"))


@query("SELECT md5(text) AS task_key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def distinct_first(spark, d):
    rows = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("task_key"), "doc_id")
    return tasks.first_of_key(rows, "doc_id")


@query(
    """SELECT source, array_to_string(list_sort(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: NOT list_contains(langs, x))), ',') AS missing
FROM (SELECT source, list(DISTINCT lang) AS langs FROM documents GROUP BY 1)"""
)
def missing_groups(spark, d):
    expected = F.array(*map(F.lit, ["de", "en", "es", "fr", "it"]))
    seen = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return seen.select("source", F.array_join(F.array_sort(F.array_except(expected, "langs")), ",").alias("missing"))


@query("SELECT max(doc_id)::INT + 1 AS next_shard FROM documents")
def next_shard(spark, d):
    names = table(spark, d, "documents").select(F.format_string("part-%05d-x.zstd.parquet", F.col("doc_id")).alias("file"))
    return sinks.next_shard(names)


@query(
    with_("hop")
    + """SELECT grp, 'question ' || grp AS query, arg_min(lang, doc_id) AS type, 'correct' AS example_type, 'multihop' AS source, count(*) AS n_docs FROM hop GROUP BY 1"""
)
def multihop_rows(spark, d):
    rows = multihop(spark, d)
    docs = nested.context_docs(F.col("context"), rows.schema["context"].dataType)
    named = rows.select("grp", F.col("question").alias("query"), "type", F.size(docs).cast("long").alias("n_docs"))
    return readers.add_if_missing(readers.add_if_missing(named, "example_type", "correct"), "source", "multihop")


@query(
    _TRACES
    + r""", f AS (SELECT conv_id, turn, """
    + _META.format(
        r"CASE WHEN regexp_matches(raw_output, '(?is)<think>.*?</think>') THEN regexp_extract(raw_output, '(?is)<think>(.*?)</think>', 1) ELSE regexp_replace(regexp_extract(raw_output, '(?is)<think>\s*(.*)$', 1), '(?is)(</think>|<\|answer_start\|>|<answer_start>|\[answer_start\]).*$', '') END"
    )
    + " AS raw, "
    + _META.format("thinking")
    + """ AS col FROM traces)
SELECT conv_id, turn, CASE WHEN raw <> '' THEN raw ELSE col END AS thinking, raw <> '' AS has_raw_think, (CASE WHEN raw <> '' THEN raw ELSE col END) <> '' AS has_thinking FROM f"""
)
def reasoning_fields(spark, d):
    return filters.reasoning_fields(_traces(spark, d)).select("conv_id", "turn", "thinking", "has_raw_think", "has_thinking")


_THINKS = """ SELECT count(*) AS rows, count(*) FILTER (regexp_matches(raw_output, '(?is)<think>')) AS rows_with_raw_think FROM outs"""


@query(with_("qa", outputs_sql(["<think>{q}</think>{a}", "{a}"])) + _THINKS)
def flag_sums(spark, d):
    rows = outputs(spark, d, ["<think>{q}</think>{a}", "{a}"]).withColumn("thinking", F.lit(""))
    flagged = filters.reasoning_fields(rows)
    return flagged.agg(F.count("*").alias("rows"), F.sum(F.col("has_raw_think").cast("long")).alias("rows_with_raw_think"))


_META_ROWS = """WITH r AS (SELECT o_custkey AS run, 'v' || (o_custkey % 3 + 1) AS grp, CASE WHEN o_custkey % 7 <> 0 THEN count(*) END AS train_rows, 'v' || (max(o_orderkey) % 3 + 1) AS claimed FROM orders GROUP BY 1)
"""


@query(
    _META_ROWS
    + """SELECT run, array_to_string(list_filter([CASE WHEN train_rows IS NULL THEN 'missing train_rows' WHEN train_rows <> 10 THEN 'train_rows=' || train_rows || ', expected=10' END,
  CASE WHEN claimed <> grp THEN 'prompt_versions=[' || claimed || ']' END, CASE WHEN claimed <> grp THEN 'allowed=[' || claimed || ']' END], lambda x: x IS NOT NULL), '; ') AS errors FROM r"""
)
def metadata_gate(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("k"))
    claimed = F.array(F.concat(F.lit("v"), (F.col("k") % 3 + 1).cast("string")))
    rows = runs.select(
        "run", F.concat(F.lit("v"), (F.col("run") % 3 + 1).cast("string")).alias("group"), F.when(F.col("run") % 7 != 0, F.col("n")).alias("train_rows"),
        claimed.alias("prompt_versions"), claimed.alias("allowed_versions"), F.create_map(F.lit("think"), F.lit("<t>")).alias("args"),
    )
    return rows.select("run", F.array_join(validation.metadata_errors(10, {"think": "<t>"}), "; ").alias("errors"))


@query(
    """SELECT c_custkey AS run, coalesce(n, 0) AS num_jobs, n IS NULL AS pending FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
)
def run_check_lookup(spark, d):
    checks = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n"))
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("run"))
    return jobs.join(checks, "run", "left").select("run", F.coalesce("n", F.lit(0)).alias("num_jobs"), F.col("n").isNull().alias("pending"))


@query("SELECT DISTINCT l_partkey AS job FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def pending_jobs(spark, d):
    """Jobs, one for each part, of which those with a line of 49 or more have a done marker."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("job"), "l_quantity")
    return validation.pending(lines.select("job").distinct(), lines.where("l_quantity >= 49"), "job")


@query("SELECT event_id, event_type, value FROM events")
def json_rows(spark, d):
    rows = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("line"))
    return rows.select(F.from_json("line", "event_id long, event_type string, value double").alias("r")).select("r.*")


@query(
    """SELECT o_orderpriority AS run_name, grp, round(loss, 9) AS loss FROM (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
UNPIVOT (loss FOR grp IN (f, o))"""
)
def group_losses(spark, d):
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    runs = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_name")).agg(mean("F").alias("f"), mean("O").alias("o"))
    return runs.unpivot("run_name", ["f", "o"], "grp", "loss").select("run_name", "grp", F.round("loss", 9).alias("loss"))


@query(
    with_("qa", outputs_sql(fixtures.CASCADE_TEMPLATES))
    + "SELECT conv_id, turn, "
    + _final_sql("raw_output")
    + " AS answer, "
    + _FIELD.format("raw_output")
    + " AS field FROM outs"
)
def answer_texts(spark, d):
    rows = outputs(spark, d, fixtures.CASCADE_TEMPLATES)
    return rows.select("conv_id", "turn", S.normalize_answer_text(F.col("raw_output")).alias("answer"), S.normalize_field(F.col("raw_output")).alias("field"))


_SUMMARIES = """WITH o AS (SELECT o_custkey AS run, count(*) AS n, o_custkey % 7 AS k FROM orders GROUP BY o_custkey),
j AS (SELECT run, CASE k WHEN 0 THEN '{"train_rows": ' || n || ', "args": {"prompt_versions": "v' || n % 3 || ',", "lr": 0.5}}' WHEN 1 THEN '{"train_rows": "' || n || '", "prompt_versions_filter": [" v1 ", ""]}'
  WHEN 2 THEN '{"train_rows": ' || n || '.5, "args": [1, 2]}' WHEN 3 THEN '{"train_rows": null, "args": {"lr": "0.5", "prompt_versions": "v1,v2"}}' WHEN 4 THEN '[' || n || ']'
  WHEN 5 THEN '{"args": {"lr": ' || n || '}, "prompt_versions_filter": "v1"}' ELSE '{"train_rows": ' || n END AS t FROM o)
"""


@query(
    _SUMMARIES
    + """, v AS (SELECT run, CASE WHEN json_valid(t) THEN t END AS t FROM j),
x AS (SELECT run, CASE json_type(t, '$.train_rows') WHEN 'UBIGINT' THEN 'integer' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' WHEN 'NULL' THEN 'null' ELSE 'missing' END AS kind,
  CASE WHEN json_type(t, '$.train_rows') = 'UBIGINT' THEN json_extract_string(t, '$.train_rows')::BIGINT ELSE -1 END AS train_rows,
  CASE WHEN json_type(t, '$.args.lr') IN ('UBIGINT', 'DOUBLE') THEN json_extract_string(t, '$.args.lr')::DOUBLE ELSE 0.25 END AS lr,
  list_filter(list_transform(CASE WHEN json_type(t, '$.prompt_versions_filter') = 'ARRAY' THEN json_extract_string(t, '$.prompt_versions_filter[*]') END, lambda s: trim(s)), lambda s: s <> '') AS listed,
  list_filter(list_transform(string_split(json_extract_string(t, '$.args.prompt_versions'), ','), lambda s: trim(s)), lambda s: s <> '') AS given FROM v)
SELECT run, kind, train_rows, lr, CASE WHEN len(listed) = 1 THEN listed[1] WHEN len(given) = 1 THEN given[1] END AS "group" FROM x"""
)
def summary_lookups(spark, d):
    """Look-ups with defaults in run summaries of seven shapes, one of them no JSON."""
    from qaflow.functions import metadata

    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n")).withColumn("k", F.pmod("run", F.lit(7)))
    n = F.col("n").cast("string")
    shapes = [
        F.concat(F.lit('{"train_rows": '), n, F.lit(', "args": {"prompt_versions": "v'), (F.col("n") % 3).cast("string"), F.lit(',", "lr": 0.5}}')),
        F.concat(F.lit('{"train_rows": "'), n, F.lit('", "prompt_versions_filter": [" v1 ", ""]}')),
        F.concat(F.lit('{"train_rows": '), n, F.lit('.5, "args": [1, 2]}')),
        F.lit('{"train_rows": null, "args": {"lr": "0.5", "prompt_versions": "v1,v2"}}'),
        F.concat(F.lit("["), n, F.lit("]")),
        F.concat(F.lit('{"args": {"lr": '), n, F.lit('}, "prompt_versions_filter": "v1"}')),
        F.concat(F.lit('{"train_rows": '), n),
    ]
    text = runs.select("run", F.get(F.array(*shapes), F.col("k").cast("int")).alias("t"))
    doc = metadata.document(F.col("t"))
    return text.select(
        "run", metadata.kind(doc, "$.train_rows").alias("kind"), metadata.value(doc, "$.train_rows", "integer", -1).alias("train_rows"),
        metadata.value(doc, "$.args.lr", "number", 0.25).alias("lr"), metadata.group(F.col("t")).alias("group"),
    )
