"""Queries over sources and sinks: rows go through a writer and a reader and must come back as SQL says."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from qaflow.functions import scoring
from qaflow.operators import filters, rendering, rollouts, tasks, validation
from qaflow.plans import fixtures
from qaflow.plans.contexts import _BLOCK
from qaflow.plans.fixtures import classed_qa, multihop, qa_pairs, table, with_
from qaflow.registry import query
from qaflow.shared import new_path
from qaflow.sources import readers, sinks
from qaflow.streaming import inference, pool

_CORPUS = "corpus AS (SELECT d.lang AS language, b.text AS query, d.text AS query_seed_text, 'u' || d.doc_id AS query_seed_url FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _corpus(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    joined = docs.withColumn("item_id", F.pmod("doc_id", F.lit(items.count()))).join(items.select("item_id", F.col("text").alias("query")), "item_id")
    return joined.select(
        F.col("lang").alias("language"), "query", F.col("text").alias("query_seed_text"), F.concat(F.lit("u"), "doc_id").alias("query_seed_url"),
        F.lit("cc").alias("seed_license"), F.col("doc_id").cast("string").alias("synth_id"),
    )


@query(
    "WITH "
    + _CORPUS
    + f""", v AS (SELECT {_STRIPPED.format("query")} AS query, {_STRIPPED.format("query_seed_text")} AS c FROM corpus WHERE language = 'en')
SELECT query, md5(regexp_replace(substr(c, 1, 6000), '\\s+$', '')) AS context_md5, '' AS reference_answer, 'synth' AS source FROM v
WHERE query <> '' AND length(query) <= 512 AND length(c) BETWEEN 300 AND 60000"""
)
def corpus_rows(spark, d):
    """Corpus written as JSON lines, scanned with its schema and turned into question rows."""
    path = new_path(spark, "corpus")
    sinks.write_lines(_corpus(spark, d), path)
    qa = readers.corpus_to_qa(readers.corpus(spark, path, "json"))
    return qa.select("query", F.md5(F.col("context").cast("binary")).alias("context_md5"), "reference_answer", "source")


@query("WITH " + _CORPUS + " SELECT language, query_seed_url FROM corpus")
def corpus_stream_resumed(spark, d):
    """A file stream run twice with one checkpoint: the second run reads only what came after the first."""
    path, out, check = (new_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    rows = _corpus(spark, d)
    even = F.pmod(F.xxhash64("synth_id"), F.lit(2)) == 0
    for part in (rows.where(even), rows.where(~even)):
        part.write.mode("append").parquet(path)
        stream = readers.corpus_stream(spark, path).select("language", "query_seed_url")
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema("language string, query_seed_url string").parquet(out)


@query(
    with_("hop")
    + f""", blocks AS (SELECT grp, doc_id, title, {_BLOCK.format(s="sentences")} AS body FROM hop WHERE grp % 3 <> 0),
joined AS (SELECT grp, string_agg(title || chr(10) || body, chr(10) || chr(10) ORDER BY doc_id) FILTER (body <> '') AS c FROM blocks GROUP BY 1)
SELECT 'question ' || grp AS query, md5(c) AS context_md5, 'answer ' || grp AS reference_answer, 'multihop' AS source FROM joined WHERE c <> ''"""
)
def multihop_split_rows(spark, d):
    """Multi-hop rows written by split; one split is scanned and turned into question rows."""
    path = new_path(spark, "multihop")
    rows = multihop(spark, d).select(
        F.col("grp").cast("string").alias("id"), "question", F.concat(F.lit("answer "), F.col("grp").cast("string")).alias("answer"), "type", "level", "context",
        "supporting_facts", F.when(F.pmod("grp", F.lit(3)) == 0, "validation").otherwise("train").alias("split"),
    )
    rows.write.partitionBy("split").parquet(path)
    qa = readers.multihop_to_qa(readers.multihop(spark, path, "train"))
    return qa.select("query", F.md5(F.col("context").cast("binary")).alias("context_md5"), "reference_answer", "source")


@query("SELECT doc_id, lang FROM documents WHERE source <> 'src3'")
def glob_projection(spark, d):
    """Several globs, two columns: the scan reads no others."""
    path = new_path(spark, "globs")
    docs = table(spark, d, "documents")
    for k, part in ((0, docs.where("source < 'src3'")), (1, docs.where("source > 'src3'"))):
        part.write.parquet(f"{path}/in{k}")
    return readers.parquet_globs(spark, [f"{path}/in0/*.parquet", f"{path}/in1/*.parquet", f"{path}/in0/*.parquet"], ["doc_id", "lang"])


@query(with_("qa") + "SELECT query, answer AS context, format FROM qa, (VALUES ('json'), ('jsonl'), ('parquet')) f(format)")
def formats_by_extension(spark, d):
    path = new_path(spark, "formats")
    rows = qa_pairs(spark, d).select("query", F.col("answer").alias("context"))
    sinks.write_lines(rows, f"{path}/a.jsonl")
    sinks.write_lines(rows, f"{path}/b.json")
    rows.write.parquet(f"{path}/c.parquet")
    found = [(kind, readers.dataset_files(spark, [f"{path}/{name}"], ["query", "context"], rows.schema)) for kind, name in (("jsonl", "a.jsonl"), ("json", "b.json"), ("parquet", "c.parquet"))]
    return readers.union_all(*[df.select("query", "context", F.lit(kind).alias("format")) for kind, df in found])


@query(with_("qa", "grounded", "classed") + "SELECT query, md5(context) AS context_md5, answer, example_type FROM classed")
def grouped_classes(spark, d):
    """One input for each class, tagged on reading."""
    path = new_path(spark, "grouped")
    rows = classed_qa(spark, d).select("query", "context", "answer", "example_type")
    kinds = ("correct", "refusal", "negative")
    for k in kinds:
        rows.where(F.col("example_type") == k).drop("example_type").write.parquet(f"{path}/{k}")
    found = readers.grouped_datasets(spark, {k: [f"{path}/{k}"] for k in kinds})
    return found.select("query", F.md5(F.col("context").cast("binary")).alias("context_md5"), "answer", "example_type")


_PLANNED = (
    with_("qa")
    + f""", t AS (SELECT {_STRIPPED.format("query")} AS query, {_STRIPPED.format("answer")} AS context, {_STRIPPED.format("answer")} AS reference_answer, 'v' || (conv_id % 3 + 1) AS prompt_version, (turn % 4)::INT AS worker
  FROM qa WHERE conv_id % 5 <> 2)
"""
)
_KEY = "sha256(query || chr(31) || context || chr(31) || reference_answer || chr(31) || prompt_version || chr(31))"


@query(_PLANNED + f"SELECT query, prompt_version, {_KEY} AS task_key FROM t WHERE query <> '' AND context <> ''")
def worker_task_lines(spark, d):
    """Tasks written as lines for each worker, after stale ones, and read back: keys are recomputed."""
    path = new_path(spark, "tasks")
    version = F.concat(F.lit("v"), (F.pmod("conv_id", F.lit(3)) + 1).cast("string")).alias("prompt_version")
    rows = qa_pairs(spark, d).select(
        F.concat(F.lit(" "), "query").alias("query"), F.col("answer").alias("context"), F.col("answer").alias("reference_answer"), version, F.lit("stale").alias("task_key"),
        F.pmod("turn", F.lit(4)).cast("int").alias("worker"), "conv_id",
    )
    sinks.write_worker_tasks(rows.drop("conv_id"), path)
    sinks.write_worker_tasks(rows.where("pmod(conv_id, 5) <> 2").drop("conv_id"), path)
    return readers.task_file(spark, path).select("query", "prompt_version", "task_key")


@query(
    _PLANNED
    + f""", k AS (SELECT {_KEY} AS task_key, worker FROM t)
SELECT worker::VARCHAR AS rank, count(*) AS rows, count(DISTINCT task_key) AS distinct_keys, CASE WHEN worker = 1 THEN count(*) ELSE 0 END AS noted FROM k GROUP BY worker"""
)
def outputs_of_all_ranks(spark, d):
    """Outputs in a folder for each rank, one of them with an extra column, are scanned as one."""
    path = new_path(spark, "outputs")
    version = F.concat(F.lit("v"), (F.pmod("conv_id", F.lit(3)) + 1).cast("string")).alias("prompt_version")
    answer = F.btrim("answer")
    rows = qa_pairs(spark, d).where("pmod(conv_id, 5) <> 2").select(F.btrim("query").alias("query"), answer.alias("context"), answer.alias("reference_answer"), version, "turn")
    for rank in range(4):
        part = rows.where(F.pmod("turn", F.lit(4)) == rank).drop("turn")
        (part.withColumn("note", F.lit("x")) if rank == 1 else part).write.parquet(sinks.rank_dir(path, rank))
    found = readers.earlier_outputs(spark, [f"{path}.rank*"])
    keyed = tasks.with_key(found).withColumn("rank", F.regexp_extract("input_file", "[.]rank([0-9]+)/", 1))
    return keyed.groupBy("rank").agg(F.count("*").alias("rows"), F.countDistinct("task_key").alias("distinct_keys"), F.count("note").alias("noted"))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 8 = 3 AND doc_id > 100")
def shard_after_offset(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return readers.after_offset(readers.shard(docs, "doc_id", 8, 3), "doc_id", 100)


@query(
    """WITH r AS (SELECT o_custkey % 40 AS run, count(*) AS n FROM orders GROUP BY 1)
SELECT 'run' || run AS run_name, 'v' || (run % 4 + 1) AS "group", n AS train_rows FROM r WHERE run % 4 IN (0, 2) AND run % 5 <> 1"""
)
def run_discovery(spark, d):
    """Summaries in nested run folders, found recursively, with the group that each claims."""
    path = new_path(spark, "runs")
    runs = table(spark, d, "orders").groupBy(F.pmod("o_custkey", F.lit(40)).alias("run")).agg(F.count("*").alias("train_rows"))
    version = F.concat(F.lit("v"), (F.pmod("run", F.lit(4)) + 1).cast("string"))
    k = F.pmod("run", F.lit(5))
    listed = F.when(k == 0, F.array(F.concat(F.lit(" "), version))).when(k == 1, F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit(" ")))
    args = F.struct(F.when(k == 1, F.lit("v1,v2")).otherwise(F.concat(version, F.lit(","))).alias("prompt_versions"))
    rows = runs.select(F.concat(F.lit("run"), F.col("run").cast("string")).alias("name"), listed.alias("prompt_versions_filter"), args.alias("args"), "train_rows")
    for r in rows.toJSON().collect():  # forty summaries
        doc = json.loads(r)
        sinks.write_text(spark, f"{path}/sweep/{doc.pop('name')}/sft_summary.json", json.dumps(doc, indent=1))
    return readers.runs_of_groups(spark, path, ["v1", "v3"]).drop("run_dir")


@query(with_("qa", "preds") + "SELECT conv_id::VARCHAR || '-' || turn AS id, gold AS gold_answer, prediction AS prediction_answer, level FROM preds")
def prediction_lines(spark, d):
    path = new_path(spark, "predictions")
    rows = fixtures.predictions(spark, d).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("gold").alias("gold_answer"), F.col("prediction").alias("prediction_answer"), "level"
    )
    sinks.write_lines(rows, path)
    return readers.prediction_lines(spark, path).select("id", "gold_answer", "prediction_answer", "level")


@query("SELECT count(*) AS rows FROM lineitem")
def footer_count(spark, d):
    return spark.createDataFrame([(readers.row_count(spark, f"{d}/lineitem.parquet"),)], "rows long")


@query(
    with_("qa")
    + """, n AS (SELECT count(*) AS n FROM qa) SELECT i::INT AS shard, least(100, n - i * 100)::BIGINT AS rows FROM n, unnest(range(0, (n + 99) // 100)) r(i)"""
)
def shards_filled_up(spark, d):
    """Three appends of odd sizes: shards are full but for the last, and no row is lost."""
    path = new_path(spark, "filled")
    rows = qa_pairs(spark, d)
    for k in range(3):
        sinks.append_shards(rows.where(F.pmod("conv_id", F.lit(3)) == k), ["conv_id", "turn"], path, 100)
    read = spark.read.parquet(path)
    return read.dropDuplicates(["conv_id", "turn"]).groupBy("shard").agg(F.count("*").alias("rows"))


@query(
    with_("qa", "grounded", "classed")
    + "SELECT CASE WHEN conv_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split, example_type, count(*) AS rows FROM classed GROUP BY ALL"
)
def split_folders(spark, d):
    path = new_path(spark, "splits")
    rows = classed_qa(spark, d).withColumn("split", F.when(F.pmod("conv_id", F.lit(4)) == 0, "validation").otherwise("train"))
    sinks.write_splits(rows, path, 50)
    return spark.read.parquet(path).groupBy("split", "example_type").agg(F.count("*").alias("rows"))


@query(with_("qa") + "SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN answer END AS reason, part FROM qa, (VALUES (0), (1)) p(part) WHERE turn % 3 <> 1")
def dead_letter_lines(spark, d):
    """Rows routed by their reason, dead letters appended twice."""
    path = new_path(spark, "dead")
    rows = qa_pairs(spark, d).withColumn("reason", F.when(F.pmod("turn", F.lit(3)) != 1, F.col("answer")))
    _, dead = sinks.routed(rows)
    for part in (0, 1):
        sinks.append_dead_letters(dead.select("conv_id", "turn", "reason", F.lit(part).alias("part")), path)
    return spark.read.schema("conv_id long, turn long, reason string, part int").json(path)


@query("SELECT source, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def stats_documents(spark, d):
    """A small table as JSON documents, read back with its schema."""
    path = new_path(spark, "stats")
    stats = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    sinks.write_document(stats, path)
    return spark.read.schema(stats.schema).json(path)


@query("SELECT n_name, n_regionkey FROM nation")
def csv_table(spark, d):
    path = new_path(spark, "csv")
    rows = table(spark, d, "nation").select("n_name", "n_regionkey")
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def rebuild_overwrites(spark, d):
    """A second build is refused unless allowed, and then leaves nothing of the first."""
    path = new_path(spark, "rebuild")
    rows = table(spark, d, "region").select("r_regionkey", "r_name")
    sinks.write_new(rows, path)
    try:
        sinks.write_new(rows, path)
    except Exception as e:  # noqa: BLE001
        if "exist" not in str(e).lower():
            raise
        sinks.write_new(rows.where("r_regionkey > 1"), path, allow_existing=True)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT event_id, event_type, part FROM events JOIN (VALUES (0), (1), (2)) p(part) ON event_id % 3 = part")
def merged_lines(spark, d):
    """A run history appended part by part, and the parts of several folders read as one."""
    path = new_path(spark, "merged")
    rows = table(spark, d, "events").select("event_id", "event_type", F.pmod("event_id", F.lit(3)).cast("int").alias("part"))
    for part in range(3):
        sinks.write_lines(rows.where(F.col("part") == part), f"{path}/shard{part}" if part else f"{path}/shard1", "append")
    return spark.read.schema(rows.schema).json(f"{path}/shard*")


@query("SELECT doc_id, length(text)::INT AS chars FROM documents WHERE doc_id % 2 = 0")
def replayed_batches(spark, d):
    """Micro-batches run twice from the start, as after a failure that lost the checkpoint: nothing is added twice."""
    path, done = new_path(spark, "batches-in"), new_path(spark, "batches-out")
    rows = table(spark, d, "documents").where("pmod(doc_id, 2) = 0").select("doc_id", "text")
    rows.write.parquet(path)
    for run in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(path)
        work = lambda df: df.select("doc_id", F.length("text").alias("chars"))
        pool.process_batches(stream, work, done, "doc_id", new_path(spark, f"batches-state{run}")).awaitTermination()
    return spark.read.schema("doc_id long, chars int").parquet(done)


# --- operators without a query elsewhere ---


@query(
    """SELECT conv_id, turn, contains(text, 'th') AS thinking, CASE WHEN contains(text, 'th') THEN 0.6 ELSE 0.7 END::DOUBLE AS temperature,
  CASE WHEN contains(text, 'th') THEN 0.95 ELSE 0.8 END::DOUBLE AS top_p, 20 AS top_k, CASE WHEN conv_id % 4 = 0 THEN 64 ELSE 512 END AS max_tokens FROM conversations WHERE role = 'user'"""
)
def sampling_defaults(spark, d):
    """Requests with the sampling parameters of their mode, where they give none themselves."""
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.contains("text", F.lit("th")).alias("thinking"), F.when(F.pmod("conv_id", F.lit(4)) == 0, 64).alias("max_tokens"))
    return asked.select("conv_id", "turn", "thinking", inference.sampling_columns(F.col("thinking"), max_tokens=F.col("max_tokens")).alias("p")).select("conv_id", "turn", "thinking", "p.*")


@query(
    with_("qa", "preds")
    + "SELECT conv_id || '-' || turn AS id, trim(gold) AS gold_answer, trim(prediction) AS prediction, coalesce(type, 'unknown') AS type, coalesce(level, 'unknown') AS level, length(gold)::INT AS context_chars, 'all' AS context_mode FROM preds"
)
def prediction_rows(spark, d):
    return scoring.prediction_rows(
        fixtures.predictions(spark, d).withColumns({"id": F.concat_ws("-", "conv_id", "turn"), "context": F.col("gold")}), "gold", "prediction", "context", "all"
    )


@query(
    with_("qa")
    + r"""SELECT conv_id, turn, CASE conv_id % 2 WHEN 0 THEN 'Be brief.' ELSE 'Think first.' END AS system, array_to_string(list_filter(regexp_split_to_array(trim(answer), '\s+'), lambda x: x <> '')[1:CASE conv_id % 2 WHEN 0 THEN 3 ELSE 8 END], ' ') AS thinking FROM qa"""
)
def version_prompts(spark, d):
    """System prompt and cap of the thinking by prompt version."""
    version = F.when(F.pmod("conv_id", F.lit(2)) == 0, "v1").otherwise("v2")
    from qaflow.functions.strings import words

    cap = rendering.thinking_cap(version, 8, {"v1": 3})
    capped = F.array_join(F.slice(words(F.col("answer")), F.lit(1), cap), " ")
    prompt = rendering.system_prompt(version, {"v1": "Be brief.", "v2": "Think first."})
    return qa_pairs(spark, d).select("conv_id", "turn", prompt.alias("system"), capped.alias("thinking"))


@query(
    with_("hop")
    + """SELECT grp, md5('Use the passages.' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[' || (doc_id - grp * 10 + 1) || '] ' || title, chr(10) ORDER BY doc_id) || chr(10) || chr(10) || 'Question: question ' || grp ||
  chr(10) || chr(10) || 'Your answer should be short.' || chr(10) || 'End your response with "Answer:" followed by your final answer.') AS prompt_md5 FROM hop GROUP BY 1"""
)
def instruct_prompts(spark, d):
    rows = multihop(spark, d)
    prompt = rendering.instruct_content(F.col("question"), F.col("context.title"), "Use the passages.", "short")
    return rows.select("grp", F.md5(prompt.cast("binary")).alias("prompt_md5"))


@query(
    with_("hop")
    + r""", raw AS (SELECT grp, title, doc_id, array_to_string(list_filter(list_transform(sentences, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS body,
  regexp_replace(sentences[1], '^\s+|\s+$', '', 'g') AS first FROM hop),
c AS (SELECT grp, string_agg(title || chr(10) || body, chr(10) || chr(10) ORDER BY doc_id) FILTER (body <> '') AS pairs,
  string_agg(title || chr(10) || first, chr(10) || chr(10) ORDER BY doc_id) FILTER (first <> '') AS single FROM raw GROUP BY 1)
SELECT grp, md5(pairs) AS pairs_md5, md5(pairs) AS structs_md5, md5(single) AS single_md5 FROM c"""
)
def context_encodings(spark, d):
    """The other encodings of a context: pairs, structs, and structs with one sentence; white space inside is kept."""
    from qaflow.functions import docs as nested

    rows = multihop(spark, d)
    zipped = F.arrays_zip("context.title", "context.sentences")
    shaped = rows.select(
        "grp",
        F.transform(zipped, lambda z: F.struct(z["title"].alias("_1"), z["sentences"].alias("_2"))).alias("pairs"),
        F.transform(zipped, lambda z: F.struct(z["title"].alias("title"), z["sentences"].alias("sentences"))).alias("structs"),
        F.transform(zipped, lambda z: F.struct(z["title"].alias("title"), F.get(z["sentences"], 0).alias("sentence"))).alias("single"),
    )

    def text_md5(c):
        docs = nested.context_docs(F.col(c), shaped.schema[c].dataType)
        empty = F.array().cast("array<struct<title:string,sent_id:int>>")
        return F.md5(nested.assemble(docs, empty, "all", 0, collapse_ws=False).cast("binary")).alias(f"{c}_md5")

    return shaped.select("grp", text_md5("pairs"), text_md5("structs"), text_md5("single"))


@query(
    with_("qa")
    + """SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'IDK' WHEN 1 THEN 'IDK' ELSE trim(answer) END AS answer FROM qa"""
)
def free_text_refusals(spark, d):
    from qaflow.functions.strings import free_text_refusal

    k = F.pmod("conv_id", F.lit(3))
    said = F.when(k == 0, F.concat(F.lit(" I DON'T know, but "), "answer")).when(k == 1, "i dont know ").otherwise(F.col("answer"))
    return qa_pairs(spark, d).select("conv_id", "turn", free_text_refusal(said, "IDK").alias("answer"))


@query(
    """WITH p AS (SELECT o_custkey AS run, o_custkey % 5 AS k, o_orderkey AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
w AS (SELECT run, k, CASE k WHEN 0 THEN n % 7 + 1 WHEN 4 THEN 0 ELSE k END::DOUBLE AS correct, CASE WHEN k IN (1, 2) THEN 2 ELSE 0 END::DOUBLE AS refusal, CASE k WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 1.5 END AS negative FROM p)
SELECT run, correct / (correct + refusal + negative) AS correct, refusal / (correct + refusal + negative) AS refusal, negative / (correct + refusal + negative) AS negative FROM w WHERE k <> 4"""
)
def ratio_spec(spark, d):
    """Mixture specifications, one text for each run, as shares of the classes; specifications without a positive weight have none."""
    from qaflow.functions.strings import ratio_shares
    from qaflow.operators.mixing import CLASSES

    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.min("o_orderkey").alias("n")).withColumn("k", F.pmod("run", F.lit(5)))
    k = F.col("k")
    spec = (
        F.when(k == 0, F.concat(F.lit(" correct:"), (F.col("n") % 7 + 1).cast("string"), F.lit(", negative:1.5")))
        .when(k == 1, "correct:1,refusal:2,negative: 1.5")
        .when(k == 2, " refusal : 2 ,negative:1.5,,correct:2")
        .when(k == 3, "correct:3")
        .otherwise("correct:0,refusal:0")
    )
    shares = first.select("run", ratio_shares(spec, CLASSES).alias("s")).where("s IS NOT NULL")
    return shares.select("run", *[F.element_at("s", F.lit(c)).alias(c) for c in CLASSES])


@query(with_("hop") + "SELECT grp, count(*) FILTER (quality = 1) AS n_gold FROM hop GROUP BY 1 HAVING n_gold > 0")
def required_arrays(spark, d):
    rows = multihop(spark, d).withColumn("gold", F.col("supporting_facts.title"))
    return filters.non_empty(rows, ["question", "gold"]).select("grp", F.size("gold").cast("long").alias("n_gold"))


_EVAL = with_("qa") + ", r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5(concat_ws(':', conv_id, turn, '77')), conv_id, turn) AS n FROM qa)\n"


@query(
    _EVAL
    + """SELECT conv_id, turn, i AS draw FROM unnest(range(1, 21)) d(i) JOIN r ON r.n = ('0x' || substr(md5(concat_ws(':', i, '77')), 1, 15))::BIGINT % (SELECT count(*) FROM qa) + 1"""
)
def eval_sample(spark, d):
    return rollouts.sample_eval(qa_pairs(spark, d).select("conv_id", "turn"), ["conv_id", "turn"], 20, 77)


@query(_EVAL + "SELECT conv_id, turn, n AS draw FROM r")
def eval_sample_all(spark, d):
    return rollouts.sample_eval(qa_pairs(spark, d).select("conv_id", "turn"), ["conv_id", "turn"], 0, 77)


_CHECKS = """WITH runs AS (SELECT DISTINCT l_suppkey % 6 AS run FROM lineitem),
checks AS (SELECT l_suppkey % 6 AS run, 'checkpoint-' || (l_linenumber * 100) AS label, max(l_linenumber)::BIGINT * 100 AS step FROM lineitem GROUP BY ALL)
"""


@query(
    _CHECKS
    + """SELECT (row_number() OVER (ORDER BY 'v' || (run % 2), 'run' || run, label) - 1)::INT AS job_no, 'v' || (run % 2) AS "group", 'run' || run AS run_name, label, step FROM checks JOIN runs USING (run)"""
)
def eval_jobs(spark, d):
    """The validation's job table, sorted by group, run and label."""
    lines = table(spark, d, "lineitem")
    run = F.concat(F.lit("run"), F.pmod("l_suppkey", F.lit(6)).cast("string")).alias("run_name")
    runs = lines.select(run, F.concat(F.lit("v"), F.pmod(F.pmod("l_suppkey", F.lit(6)), F.lit(2)).cast("string")).alias("group")).distinct()
    checks = lines.select(run, F.concat(F.lit("checkpoint-"), (F.col("l_linenumber") * 100).cast("string")).alias("label")).distinct()
    return validation.eval_jobs(runs, checks, "all")


@query(
    """SELECT c_mktsegment AS model, count(*) FILTER (c_nationkey = 3) > 0 AS ok, CASE WHEN count(*) FILTER (c_nationkey = 3) > 0 THEN '' ELSE 'tok3' END || CASE WHEN true THEN '' END AS missing
FROM (SELECT 'model' || (c_custkey % 5) AS c_mktsegment, c_nationkey FROM customer) GROUP BY 1"""
)
def special_tokens(spark, d):
    """Which models' vocabularies lack an expected token."""
    words = table(spark, d, "customer").select(
        F.concat(F.lit("model"), F.pmod("c_custkey", F.lit(5)).cast("string")).alias("model"), F.concat(F.lit("tok"), F.col("c_nationkey").cast("string")).alias("token")
    )
    found = validation.missing_tokens(words, {"thinking_start": "tok3"})
    return found.select("model", "ok", F.array_join("missing_tokens", ",").alias("missing"))


@query(
    """WITH grid AS (SELECT 'run' || i AS run_name, i FROM range(12) r(i)),
l AS (SELECT 'run' || (o_custkey % 10) AS run_name, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1),
m AS (SELECT g.run_name, (f + o) / 2 AS loss FROM grid g LEFT JOIN l ON l.run_name = g.run_name)
SELECT run_name, round(loss, 6) AS mean_group_loss, CASE WHEN loss IS NULL THEN 'pending' ELSE 'ok' END AS status, row_number() OVER (ORDER BY loss ASC NULLS LAST, run_name)::INT AS rank FROM m"""
)
def mixture_sweep(spark, d):
    """Configurations, their finished losses, and the ranking with pending ones last."""
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    name = F.concat(F.lit("run"), F.pmod("o_custkey", F.lit(10)).cast("string")).alias("run_name")
    losses = table(spark, d, "orders").groupBy(name).agg(mean("F").alias("f"), mean("O").alias("o"))
    grid = validation.grid(spark, {"lr": [1e-5, 2e-5, 5e-5], "mix": ["a", "b"], "epochs": [1, 2]}).withColumn("run_name", F.concat(F.lit("run"), F.col("ordinal").cast("string")))
    found = validation.sweep(grid.select("run_name"), losses, ["f", "o"])
    return found.select("run_name", F.round("mean_group_loss", 6).alias("mean_group_loss"), "status", "rank")


@query(
    """WITH e AS (SELECT 'run' || (l_orderkey % 7) AS run_name, 'checkpoint-' || (l_linenumber * 100) AS label, l_linenumber AS ordinal, round(avg(l_quantity), 1) AS em FROM lineitem GROUP BY ALL),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY em DESC, ordinal) = 1),
g AS (SELECT 'run' || i AS run_name, 'g' || (i % 3) AS grp, label, em FROM range(9) r(i) LEFT JOIN b ON b.run_name = 'run' || i)
SELECT run_name, grp, label, em AS exact_match, CASE WHEN label IS NULL THEN 'pending' ELSE 'ok' END AS status, row_number() OVER (ORDER BY em DESC NULLS LAST, run_name)::INT AS rank,
  label IS NOT NULL AND row_number() OVER (PARTITION BY grp ORDER BY em DESC NULLS LAST, run_name) = 1 AS best_of_group FROM g"""
)
def checkpoint_sweep(spark, d):
    """Runs of a grid, their best checkpoints, the ranking, and the best of each group."""
    name = F.concat(F.lit("run"), F.pmod("l_orderkey", F.lit(7)).cast("string")).alias("run_name")
    evals = table(spark, d, "lineitem").groupBy(name, F.col("l_linenumber").alias("ordinal")).agg(F.round(F.avg("l_quantity"), 1).alias("exact_match"))
    evals = evals.withColumn("label", F.concat(F.lit("checkpoint-"), (F.col("ordinal") * 100).cast("string")))
    runs = spark.range(9).select(F.concat(F.lit("run"), F.col("id").cast("string")).alias("run_name"), F.concat(F.lit("g"), F.pmod("id", F.lit(3)).cast("string")).alias("grp"))
    found = validation.group_sweep(runs, evals, group="grp")
    return found.select("run_name", "grp", "label", "exact_match", "status", "rank", "best_of_group")


@query("SELECT o_orderpriority AS run_name, row_number() OVER (ORDER BY avg(o_totalprice) DESC NULLS LAST, o_orderpriority)::INT AS rank FROM orders GROUP BY 1")
def rank_runs_descending(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_name")).agg(F.avg("o_totalprice").alias("score"))
    return validation.ranked(runs, "score", "run_name").select("run_name", "rank")
