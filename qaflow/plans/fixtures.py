"""Input views over the test tables, each as a DataFrame and as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaflow.functions.strings import IDK
from qaflow.operators.splits import split_rows


_LOW = "abcdefghijklmnopqrstuvwxyz"  # capitals of ASCII letters only, on which both engines agree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, query, answer): a user turn and the assistant turn after it."""
    c = table(spark, sf_dir, "conversations")
    users = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return users.join(answers, ["conv_id", "turn"])


def grounded_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    qa = qa_pairs(spark, sf_dir).withColumn("doc_id", F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(n)))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    joined = qa.join(docs.select("doc_id", "text", "source"), "doc_id").join(labels, "doc_id", "left")
    return joined.select(
        "conv_id",
        "turn",
        "query",
        F.when(F.pmod("conv_id", F.lit(7)) == 3, "").otherwise(F.col("text")).alias("context"),
        F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9)) == 4, IDK).otherwise(F.col("answer")).alias("answer"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("negative"),
        "doc_id",
        "source",
    )


def classed_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(grounded_qa(spark, sf_dir))


def multihop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, question, context struct of arrays, supporting_facts struct of arrays, type, level): ten documents to an example."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").withColumn("grp", F.expr("doc_id div 10"))
    item = F.struct("doc_id", F.split("text", "\n").alias("sentences"), "lang", F.coalesce("quality", F.lit(0)).alias("quality"))
    groups = rows.groupBy("grp").agg(F.sort_array(F.collect_list(item)).alias("d"))
    title = lambda x: F.concat(F.lit("doc_"), x["doc_id"].cast("string"))
    good = F.filter("d", lambda x: x["quality"] == 1)
    return groups.select(
        "grp",
        F.concat(F.lit("question "), F.col("grp").cast("string")).alias("question"),
        F.struct(F.transform("d", title).alias("title"), F.transform("d", lambda x: x["sentences"]).alias("sentences")).alias("context"),
        F.struct(F.transform(good, title).alias("title"), F.transform(good, lambda x: F.lit(0)).alias("sent_id")).alias("supporting_facts"),
        F.get("d", 0)["lang"].alias("type"),
        F.get(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.pmod("grp", F.lit(3)).cast("int")).alias("level"),
    )


#: Templates of model outputs; {q} and {a} stand for query and answer.
CASCADE_TEMPLATES = [
    "<think>{q}</think><answer>{a}</answer>",
    "{q} <|answer_start|> {a} <|answer_end|>",
    "{q} <answer_start>{a}<answer_end>",
    "{q} <|answer_start|>{a}",
    "<think>{q}</think> <answer> {a}",
    "<think>{q}</think>\nAnswer: {a}",
    "<think>{q}</think>\nsomething\n{a}",
    "{q}\n### <final answer> {a} </final answer>",
    "{q}\nFinal answer: {a}",
    "{q}\nAnswer - {a}",
    "{q}\n**{a}**\n",
    "{q} so **{a}** it is",
    "{q}\n\n{a}",
    "<s> </s>",
]
BRACKET_TEMPLATES = [
    "[thinking_start]{q}[thinking_end][answer_start]{a}[answer_end]",
    "{q}[thinking_end][answer_start]{a}",
    "{q} [answer_start] {a} [answer_end]",
    "[thinking_start]{q}[answer_start]{a}[answer_end]",
    "[thinking_start]{q}[thinking_end]{a}[answer_end]",
    "{a}[answer_end]",
    "{q}",
]
TAG_TEMPLATES = [
    "<think>{q}</think><answer>{a}</answer>",
    "<answer>{a}</answer><think>{q}</think>",
    "<think>{q}</think> {a}",
    "<think>{q} <answer>{a}</answer>",
    "<|x|><think>{q}</think>\n<answer>{a}</answer></s>",
    "{q} {a}",
]
NATIVE_TEMPLATES = [
    "<think>{q}</think><|answer_start|>{a}<|answer_end|>",
    "<|thinking_start|>{q}<|thinking_end|><answer_start>{a}<answer_end>",
    "<|thinking_start|>{q}<|answer_start|>{a}",
    "<answer_start>{a}</answer_end>",
    "<answer>{a}</answer>",
    "{q}\nanswer: {a}",
    "{q}\n{a}",
    "",
]
JSON_TEMPLATES = ['{"answer": "x", "quotes": ["y"]}', 'text {"answer": 3} more', '{"answer": "x"} tail}', "{'answer': 'x'}", "none", '{"a": {"b": [1, 2]}}']


def filled(templates: list[str], q: Column, a: Column, n: Column) -> Column:
    """The template of number n modulo their count, filled in."""
    import re

    out = None
    number = F.pmod(n, F.lit(len(templates)))
    for i, t in enumerate(templates):
        parts = [q if p == "{q}" else a if p == "{a}" else F.lit(p) for p in re.split(r"(\{[qa]\})", t)]
        case = F.concat(*parts)
        out = F.when(number == i, case) if out is None else out.when(number == i, case)
    return out


def filled_sql(templates: list[str], q: str = "query", a: str = "answer", n: str = "conv_id * 8 + turn") -> str:
    import re

    cases = []
    for i, t in enumerate(templates):
        parts = [q if p == "{q}" else a if p == "{a}" else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in re.split(r"(\{[qa]\})", t)]
        cases.append(f"WHEN {i} THEN " + " || ".join(parts))
    return f"CASE ({n}) % {len(templates)} " + " ".join(cases) + " END"


def outputs(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    """qa_pairs with a raw output, a prompt version and a reference answer."""
    qa = qa_pairs(spark, sf_dir)
    n = F.col("conv_id") * 8 + F.col("turn")
    raw = filled(templates, F.col("query"), F.col("answer"), n)
    version = F.concat(F.lit("v"), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) + 1).cast("string"))
    reference = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.col("answer"), F.lit(" not"))).otherwise(F.col("answer"))
    return qa.select("*", raw.alias("raw_output"), version.alias("prompt_version"), reference.alias("reference_answer"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = qa_pairs(spark, sf_dir)
    k = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4))
    prediction = F.when(k == 0, F.col("answer")).when(k == 1, F.concat(F.translate("answer", _LOW, _LOW.upper()), F.lit("!"))).when(k == 2, F.col("query")).otherwise("")
    return qa.select(
        "conv_id", "turn", F.col("answer").alias("gold"), prediction.alias("prediction"),
        F.when(F.col("turn") == 0, "first").when(F.col("turn") < 3, "early").otherwise("late").alias("type"),
        F.when(F.pmod("conv_id", F.lit(5)) != 0, F.concat(F.lit("level"), F.pmod("conv_id", F.lit(3)).cast("string"))).alias("level"),
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, turn, completion, gold): a conversation's turns as completions, its first assistant turn as gold."""
    c = table(spark, sf_dir, "conversations")
    gold = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("g")).select("conv_id", F.col("g.text").alias("gold"))
    joined = c.join(gold, "conv_id")
    completion = filled(TAG_TEMPLATES, F.lit("thought"), F.col("text"), F.col("turn") + F.col("conv_id"))
    return joined.select(F.col("conv_id").alias("group_id"), "turn", completion.alias("completion"), "gold")


CTE = {
    "qa": """qa AS (
  SELECT u.conv_id, u.turn, u.text AS query, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')""",
    "grounded": """grounded AS (
  SELECT q.conv_id, q.turn, q.query, CASE WHEN q.conv_id % 7 = 3 THEN '' ELSE d.text END AS context,
    CASE WHEN (q.conv_id + q.turn) % 9 = 4 THEN 'I don''t know' ELSE q.answer END AS answer,
    coalesce(l.toxic = 1, false) AS negative, d.doc_id, d.source
  FROM qa q JOIN documents d ON d.doc_id = (q.conv_id * 31 + q.turn) % (SELECT count(*) FROM documents)
  LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "classed": r"""cleaned AS (
  SELECT conv_id, turn, regexp_replace(query, '^\s+|\s+$', '', 'g') AS query, regexp_replace(context, '^\s+|\s+$', '', 'g') AS context,
    regexp_replace(answer, '^\s+|\s+$', '', 'g') AS stripped, trim(regexp_replace(lower(answer), '\s+', ' ', 'g')) AS n, negative, doc_id, source
  FROM grounded),
canonical AS (
  SELECT *, CASE
    WHEN n IN ('i don''t know', 'i dont know', 'i cannot find the answer in the context', 'i can''t find the answer in the context',
      'cannot find the answer in the context', 'can''t find the answer in the context', 'not found in the context') THEN 'I don''t know'
    WHEN n IN ('i dont see any relevant context.', 'i dont see any relevant context', 'i don''t see any relevant context.',
      'i don''t see any relevant context', 'no relevant context') THEN 'i dont see any relevant context.'
    ELSE stripped END AS answer FROM cleaned),
everything AS (
  SELECT conv_id, turn, query, context, answer, negative, doc_id, source,
    CASE WHEN context = '' OR answer = 'i dont see any relevant context.' THEN 'refusal' WHEN negative THEN 'negative'
      WHEN answer = 'I don''t know' THEN 'refusal' ELSE 'correct' END AS example_type FROM canonical),
classed AS (SELECT * FROM everything WHERE query <> '' AND answer <> '')""",
    "hop": """hop AS (
  SELECT d.doc_id // 10 AS grp, d.doc_id, 'doc_' || d.doc_id AS title, d.lang, string_split(d.text, chr(10)) AS sentences, coalesce(l.quality, 0) AS quality
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "preds": """preds AS (
  SELECT conv_id, turn, answer AS gold, CASE (turn + conv_id) % 4 WHEN 0 THEN answer WHEN 1 THEN translate(answer, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!' WHEN 2 THEN query ELSE '' END AS prediction,
    CASE WHEN turn = 0 THEN 'first' WHEN turn < 3 THEN 'early' ELSE 'late' END AS type,
    CASE WHEN conv_id % 5 <> 0 THEN 'level' || (conv_id % 3) END AS level FROM qa)""",
}


def outputs_sql(templates: list[str]) -> str:
    return f"""outs AS (SELECT *, {filled_sql(templates)} AS raw_output, 'v' || ((conv_id + turn) % 4 + 1) AS prompt_version,
  CASE WHEN conv_id % 3 = 0 THEN answer || ' not' ELSE answer END AS reference_answer FROM qa)"""


def rollouts_sql() -> str:
    body = filled_sql(TAG_TEMPLATES, "'thought'", "c.text", "c.turn + c.conv_id")
    return f"""rolls AS (SELECT c.conv_id AS group_id, c.turn, {body} AS completion, g.gold
  FROM conversations c JOIN (SELECT conv_id, arg_min(text, turn) AS gold FROM conversations WHERE role = 'assistant' GROUP BY conv_id) g ON g.conv_id = c.conv_id)"""


def with_(*names: str) -> str:
    """A WITH clause of the named expressions; other arguments are taken as they are."""
    return "WITH " + ",\n".join(CTE.get(n, n) for n in names) + "\n"
