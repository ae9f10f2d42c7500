"""Queries over streams, logs and sinks that are written in several steps and must equal SQL over all of it; streams run twice on one checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaflow.operators import status
from qaflow.plans.fixtures import qa_pairs, table, with_
from qaflow.registry import query
from qaflow.shared import new_path
from qaflow.sources import shardlog, sinks
from qaflow.streaming import answers, inference, pool, target

MARKER = "<|answer_end|>"

# chunks of 1 to 7 characters; streams of every eleventh conversation never get their last chunk and end in a begun marker
_RAW = f"""raw AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 5 THEN text || '<|answer_e' WHEN conv_id % 3 = 0 THEN text || '{MARKER}' || text || '{MARKER}' WHEN conv_id % 3 = 1 THEN text || '<|answer_<|answer_end|' ELSE text END AS t
  FROM conversations WHERE role = 'assistant')"""


@query(
    f"""WITH {_RAW} SELECT conv_id || '-' || turn AS stream, md5(split_part(t, '{MARKER}', 1)) AS text_md5,
  CASE WHEN contains(t, '{MARKER}') THEN 'cut' WHEN conv_id % 11 = 5 THEN 'abandoned' ELSE 'end' END AS status FROM raw"""
)
def streamed_answers(spark, d):
    """Assistant turns in small chunks, half of each in a first run and the rest in a second one, cut at the end marker."""
    k, text = F.col("conv_id"), F.coalesce("text", F.lit(""))
    lost = F.pmod(k, F.lit(11)) == 5
    raw = (
        F.when(lost, F.concat(text, F.lit("<|answer_e")))
        .when(F.pmod(k, F.lit(3)) == 0, F.concat(text, F.lit(MARKER), text, F.lit(MARKER)))
        .when(F.pmod(k, F.lit(3)) == 1, F.concat(text, F.lit("<|answer_<|answer_end|")))
        .otherwise(text)
    )
    rows = table(spark, d, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("stream"), raw.alias("t"), lost.alias("lost"), (F.lit(1) + F.pmod(k, F.lit(7))).cast("int").alias("width"))
    count = F.expr("greatest(1, cast(ceil(char_length(t) / width) as int))")
    numbered = rows.withColumn("n", count).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    second = (F.col("seq") * 2 >= F.col("n")) & ~F.col("lost")
    chunks = numbered.select(
        "stream", F.col("seq").cast("long").alias("seq"), F.expr("substring(t, seq * width + 1, width)").alias("chunk"), ((F.col("seq") == F.col("n") - 1) & ~F.col("lost")).alias("last"),
        F.when(second, F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("timestamp").alias("ts"), second.alias("second"),
    )
    path, out, check = (new_path(spark, x) for x in ("chunks", "pieces", "chunks-state"))
    for part in (chunks.where(~second), chunks.where(second)):
        part.drop("second").write.mode("append").parquet(path)
        stream = spark.readStream.schema(chunks.drop("second").schema).parquet(path)
        pieces = pool.append_available(answers.cut_streams(stream, MARKER), out, check)
    whole = pieces.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("seq", "piece", "status"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return whole.select("stream", F.md5(joined.cast("binary")).alias("text_md5"), F.element_at("p", -1)["status"].alias("status"))


_TARGETS = (41, 97)


@query(
    f"""WITH n AS (SELECT (max(doc_id) + 8) // 8 AS width FROM documents),
v AS (SELECT doc_id, lang, doc_id // width AS file, md5(concat_ws(':', doc_id, '0')) AS h FROM documents, n WHERE lang = 'en'),
one AS (SELECT * FROM v ORDER BY file, h, doc_id LIMIT {_TARGETS[0]}),
two AS (SELECT * FROM v WHERE file > (SELECT max(file) FROM one) ORDER BY file, h, doc_id LIMIT {_TARGETS[1] - _TARGETS[0]})
SELECT doc_id, lang FROM one UNION ALL SELECT doc_id, lang FROM two"""
)
def stream_to_target(spark, d):
    """A file stream of one file a batch that stops at exactly 41 rows, then, restarted with a higher target, at 97."""
    path, out, check = (new_path(spark, x) for x in ("target-in", "target-out", "target-state"))
    rows = table(spark, d, "documents").select("doc_id", "lang")
    width = (rows.agg(F.max("doc_id")).first()[0] + 8) // 8
    for i in range(8):  # one after the other, so that the stream takes them in this order
        rows.where(F.expr(f"doc_id div {width}") == i).coalesce(1).write.mode("append").parquet(path)
    for wanted in _TARGETS:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        target.run_to_target(stream, lambda batch: batch.where("lang = 'en'"), wanted, ["doc_id"], out, check)
    return target.read_committed(spark, out, rows.schema)


_URLS = "e AS (SELECT event_id, (event_id % 2)::INT AS lane, 'u' || (user_id % 3) AS url, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) - 1 AS n FROM events)"
_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _url_runs(spark, d):
    """Two runs of the pool over the earlier and the later half of the events; yields the draws and the checkpoint after each."""
    events = table(spark, d, "events").select("event_id", F.concat(F.lit("u"), F.pmod("user_id", F.lit(3)).cast("string")).alias("url"), F.col("event_type").alias("context"))
    half = events.agg(F.max("event_id")).first()[0] // 2
    path, out, check = (new_path(spark, x) for x in ("events", "draws", "draws-state"))
    for part in (events.where(F.col("event_id") < half), events.where(F.col("event_id") >= half)):
        part.write.mode("append").parquet(path)
        yield pool.append_available(pool.draw_stream(spark.readStream.schema(events.schema).parquet(path), lanes=2), out, check), check


@query(
    f"""WITH {_URLS}, drawn AS (SELECT *, least(n, 4096) AS k FROM e WHERE n >= 256 AND {_HASH.format("event_id || ':3:draw'")} < 0.35 * 4294967296),
tries AS (SELECT d.*, t, n - k + {_HASH.format("event_id || ':3' || CASE WHEN t > 0 THEN ':' || t ELSE '' END")} % k AS m FROM drawn d, unnest(range(11)) u(t)),
found AS (SELECT t.*, p.event_id AS partner_id, p.url AS partner_url FROM tries t JOIN e p ON p.lane = t.lane AND p.n = t.m)
SELECT lane, event_id, partner_id, partner_url, t::INT AS tries, k::INT AS pool_size FROM found
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY partner_url <> url DESC, CASE WHEN partner_url <> url THEN t ELSE -t END) = 1"""
)
def url_pool(spark, d):
    """Partners with another URL from the last 4,096 rows of a lane, for about a third of the rows after the first 256."""
    *_, (draws, _) = _url_runs(spark, d)
    return draws.drop("partner_context")


@query(
    f"""WITH {_URLS}, runs AS (SELECT 1 AS run, max(event_id) // 2 AS bound FROM events UNION ALL SELECT 2, max(event_id) + 1 FROM events),
seen AS (SELECT run, e.*, count(*) OVER (PARTITION BY run, lane) AS total FROM e JOIN runs ON event_id < bound)
SELECT run, lane, (n % 4096)::INT AS slot, event_id, url, total AS rows_seen FROM seen WHERE n >= total - 4096"""
)
def url_pool_state(spark, d):
    """The rings and counters that each of two runs leaves in the checkpoint, read back as tables; the second run goes on with the first one's."""
    found = None
    for run, (_, check) in enumerate(_url_runs(spark, d), 1):
        state = pool.pool_state(spark, check).join(pool.pool_counters(spark, check), "lane")
        path = new_path(spark, "pool-state")
        state.select(F.lit(run).alias("run"), "lane", "slot", "event_id", "url", F.col("n").alias("rows_seen")).write.parquet(path)
        rows = spark.read.parquet(path)
        found = rows if found is None else found.unionByName(rows)
    return found


_LOGGED = """WITH l AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS n FROM documents),
s AS (SELECT *, n // 40 AS shard FROM l), r AS (SELECT *, (shard % 3)::INT AS rank, row_number() OVER (PARTITION BY shard % 3 ORDER BY n) AS k FROM s)
"""


def _logged(spark, d):
    """Documents appended in two transactions, the second of which is replayed: even doc_ids in order, then odd ones."""
    spark.dataSource.register(shardlog.ShardLog)
    path = new_path(spark, "log")
    for odd in (0, 1, 1):
        part = table(spark, d, "documents").where(F.pmod("doc_id", F.lit(2)) == odd).select("doc_id", "lang").orderBy("doc_id")
        part.write.format("shardlog").mode("append").options(rowsPerShard=40, transaction=f"part-{odd}").save(path)
    return path


@query(_LOGGED + "SELECT rank, doc_id, lang FROM r WHERE k > 50")
def logged_ranks_resumed(spark, d):
    """The shards of three ranks, each from its 51st row on."""
    path = _logged(spark, d)
    ranks = [spark.read.format("shardlog").options(world=3, rank=i, after=50).load(path).select(F.lit(i).alias("rank"), "doc_id", "lang") for i in range(3)]
    return ranks[0].unionByName(ranks[1]).unionByName(ranks[2])


@query("SELECT doc_id, lang FROM documents")
def logged_stream(spark, d):
    """The log as a stream with row numbers as offsets: a run, an append, and a second run that reads what is new."""
    spark.dataSource.register(shardlog.ShardLog)
    path, out, check = (new_path(spark, x) for x in ("log", "log-out", "log-state"))
    found = None
    for odd in (0, 1):
        part = table(spark, d, "documents").where(F.pmod("doc_id", F.lit(2)) == odd).select("doc_id", "lang")
        part.write.format("shardlog").mode("append").options(rowsPerShard=100, transaction=f"part-{odd}").save(path)
        found = pool.append_available(spark.readStream.format("shardlog").load(path), out, check)
    return found


_JOBS = """WITH e AS (SELECT 'job' || (user_id % 97) AS job, (event_id // 700)::INT AS attempt, event_id % 3 AS kind, event_id AS seen, event_type AS detail FROM events)
"""


def _status_log(spark, d):
    """Starts, failures and ends of 97 jobs in four batches, one of them replayed, with a compaction in between."""
    n = F.col("event_id")
    events = table(spark, d, "events").select(
        F.concat(F.lit("job"), F.pmod("user_id", F.lit(97)).cast("string")).alias("job"), F.expr("cast(event_id div 700 as int)").alias("attempt"),
        F.get(F.array(*map(F.lit, status.KINDS)), F.pmod(n, F.lit(3)).cast("int")).alias("event"), n.alias("at"), F.col("event_type").alias("detail"),
    )
    path = new_path(spark, "status")
    for batch in (0, 1, 1, 2, 3):
        status.append_events(events.where(F.pmod(F.xxhash64("at"), F.lit(4)) == batch), path, batch)
        if batch == 2:
            status.compact(spark, path)
    return path


@query(
    _JOBS
    + """SELECT job, attempt, (['running', 'failed', 'finished'])[kind + 1] AS state, seen AS "at", detail FROM e
QUALIFY row_number() OVER (PARTITION BY job ORDER BY attempt DESC, kind DESC, seen DESC, detail DESC) = 1"""
)
def job_status(spark, d):
    """The last state of every job from an append-only log, across a replayed batch and a compaction."""
    return status.latest(spark, _status_log(spark, d)).select("job", "attempt", "state", "at", "detail")


@query("SELECT CASE WHEN lang = 'en' THEN 'written' WHEN lang = 'fr' THEN 'french' ELSE 'other' END AS outcome, count(*) AS rows FROM documents GROUP BY 1")
def write_counters(spark, d):
    """Written and failed rows counted by the jobs that write them."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "en", F.when(F.col("lang") == "fr", "french").otherwise(F.coalesce("lang", F.lit("none")))).alias("reason"))
    good, dead = sinks.routed(rows)
    counts, path = sinks.Outcomes(("french",)), new_path(spark, "counted")
    sinks.write_shards(counts.written(good), f"{path}/out", 100)
    sinks.append_dead_letters(counts.failed(dead), f"{path}/failed")
    return counts.table(spark)


@query(
    with_("qa")
    + r"""SELECT conv_id, turn, '<think>' || array_to_string(list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '')[1:8], ' ') || '</think><answer>' ||
  list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '')[-1] || '</answer>' AS raw_output FROM qa"""
)
def slot_inference(spark, d):
    """The stand-in model on four slots that start together."""
    return inference.infer_on_slots(qa_pairs(spark, d), "query", 4, batch_size=32).select("conv_id", "turn", "raw_output")
