"""Queries over multi-hop contexts, rendered prompts and parsed outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaflow.functions import docs as nested
from qaflow.functions import parsers
from qaflow.functions.strings import cut_at
from qaflow.operators import filters, rendering
from qaflow.plans import fixtures
from qaflow.plans.fixtures import multihop, outputs, outputs_sql, table, with_
from qaflow.registry import query

_BLOCK = r"""trim(regexp_replace(array_to_string(list_filter(list_transform({s}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' '), '\s+', ' ', 'g'))"""


def _digests(contexts):
    """Length and digest of each context, which is made once for both."""
    return contexts.select("grp", F.length("c").cast("long").alias("context_chars"), F.md5(F.col("c").cast("binary")).alias("context_md5"))


def _context(spark, d, mode, cap=0):
    rows = multihop(spark, d)
    docs = nested.context_docs(F.col("context"), rows.schema["context"].dataType)
    pairs = nested.supporting_pairs(F.col("supporting_facts"), rows.schema["supporting_facts"].dataType)
    return _digests(rows.select("grp", nested.assemble(docs, pairs, mode, cap).alias("c")))


def _context_sql(chosen: str, cap: int = 0) -> str:
    text = f"regexp_replace(substr(c, 1, {cap}), '\\s+$', '')" if cap else "c"
    return (
        with_("hop")
        + f""", chosen AS ({chosen}),
blocks AS (SELECT grp, doc_id, title, {_BLOCK.format(s="sentences")} AS body FROM chosen),
joined AS (SELECT g.grp, coalesce(string_agg(title || chr(10) || body, chr(10) || chr(10) ORDER BY doc_id) FILTER (body <> ''), '') AS c
  FROM (SELECT DISTINCT grp FROM hop) g LEFT JOIN blocks b ON b.grp = g.grp GROUP BY 1)
SELECT grp, length({text}) AS context_chars, md5({text}) AS context_md5 FROM joined"""
    )


_SOME = "EXISTS (SELECT 1 FROM hop h WHERE h.grp = hop.grp AND h.quality = 1)"


@query(_context_sql("SELECT * FROM hop"))
def context_all(spark, d):
    return _context(spark, d, "all")


@query(_context_sql("SELECT * FROM hop", 3000))
def context_capped(spark, d):
    return _context(spark, d, "all", 3000)


@query(_context_sql(f"SELECT * FROM hop WHERE quality = 1 OR NOT {_SOME}"))
def context_gold(spark, d):
    return _context(spark, d, "gold_titles")


@query(_context_sql(f"SELECT * EXCLUDE (sentences), CASE WHEN {_SOME} THEN sentences[1:1] ELSE sentences END AS sentences FROM hop WHERE quality = 1 OR NOT {_SOME}"))
def context_supporting(spark, d):
    return _context(spark, d, "supporting")


_PICKED = "CASE WHEN quality = 1 THEN list_filter(sentences, lambda s, i: i - 1 IN (doc_id % 3, doc_id % 5)) ELSE [] END"


@query(
    _context_sql(
        f"SELECT grp, doc_id, title, CASE WHEN max(len({_PICKED})) OVER (PARTITION BY grp) > 0 THEN {_PICKED} ELSE sentences END AS sentences FROM hop "
        f"QUALIFY max(len({_PICKED})) OVER (PARTITION BY grp) = 0 OR len({_PICKED}) > 0"
    )
)
def supporting_sentences(spark, d):
    """Contexts cut to supporting sentences whose ids vary, repeat, run past the end, or are no integers."""
    rows = multihop(spark, d)
    number = lambda t: F.substring_index(t, "_", -1).cast("long")
    ids = lambda t: F.array((number(t) % 3).cast("string"), F.lit("x"), F.lit(None).cast("string"), (number(t) % 5).cast("string"), F.lit("1000"), F.lit("1.5"), F.lit("-1"))
    titles = F.col("supporting_facts.title")
    facts = F.struct(
        F.flatten(F.transform(titles, lambda t: F.array_repeat(t, 7))).alias("title"), F.flatten(F.transform(titles, ids)).alias("sent_id")
    )
    shaped = rows.select("grp", "context", facts.alias("facts"))
    docs = nested.context_docs(F.col("context"), shaped.schema["context"].dataType)
    pairs = nested.supporting_pairs(F.col("facts"), shaped.schema["facts"].dataType)
    return _digests(shaped.select("grp", nested.assemble(docs, pairs, "supporting").alias("c")))


_PASSAGE = "title || ' | ' || array_to_string(sentences, ' ')"


@query(
    with_("hop")
    + f""", tagged AS (SELECT grp, title, quality, {_PASSAGE} AS passage, md5(concat_ws(':', grp, '19', 'gold', title)) AS og, md5(concat_ws(':', grp, '19', 'other', title)) AS oo,
  md5(concat_ws(':', grp, '19', 'mix', title)) AS om FROM hop),
numbered AS (SELECT *, CASE WHEN quality = 1 THEN row_number() OVER (PARTITION BY grp, quality = 1 ORDER BY og) END AS g,
  CASE WHEN quality <> 1 THEN row_number() OVER (PARTITION BY grp, quality = 1 ORDER BY oo) END AS o, count(*) FILTER (quality = 1) OVER (PARTITION BY grp) AS n FROM tagged),
picked AS (SELECT * FROM numbered WHERE g <= 4 OR o <= greatest(4 - n, 0))
SELECT grp, count(*) AS n_passages, md5(string_agg(passage, chr(31) ORDER BY om)) AS passages_md5 FROM picked GROUP BY 1"""
)
def passages_select(spark, d):
    rows = multihop(spark, d)
    docs = nested.context_docs(F.col("context"), rows.schema["context"].dataType)
    titles = nested.supporting_titles(nested.supporting_pairs(F.col("supporting_facts"), rows.schema["supporting_facts"].dataType))
    passages = nested.select_passages(docs, titles, 4, F.col("grp"), 19)
    found = rows.select("grp", passages.alias("p"))
    return found.select("grp", F.size("p").cast("long").alias("n_passages"), F.md5(F.array_join("p", "\x1f").cast("binary")).alias("passages_md5"))


@query(
    with_("hop")
    + f"""SELECT grp, md5(string_agg('[' || (doc_id - grp * 10 + 1) || '] ' || {_PASSAGE}, chr(10) ORDER BY doc_id)) AS numbered_md5 FROM hop GROUP BY 1"""
)
def numbered_passages(spark, d):
    rows = multihop(spark, d)
    docs = nested.context_docs(F.col("context"), rows.schema["context"].dataType)
    return rows.select("grp", F.md5(rendering.numbered(F.transform(docs, nested.format_passage)).cast("binary")).alias("numbered_md5"))


@query(
    with_("qa")
    + """SELECT conv_id, turn, md5('[context_start]' || answer || '[context_end][query_start]' || query || '[query_end][answer_start]') AS prompt_md5,
  md5('[context_start]' || answer || '[context_end][query_start]' || query || '[query_end][answer_start]' || answer || '[answer_end]') AS text_md5,
  md5('CONTEXT:' || chr(10) || answer || chr(10) || chr(10) || 'QUESTION:' || chr(10) || query || chr(10) || chr(10) || 'Return JSON.') AS json_md5 FROM qa"""
)
def prompt_render(spark, d):
    qa = fixtures.qa_pairs(spark, d)
    md5 = lambda c: F.md5(c.cast("binary"))
    q, a = F.col("query"), F.col("answer")
    return qa.select(
        "conv_id",
        "turn",
        md5(rendering.bracket_prompt(q, a)).alias("prompt_md5"),
        md5(rendering.bracket_text(q, a, a)).alias("text_md5"),
        md5(rendering.user_content(q, a, True, "")).alias("json_md5"),
    )


@query(
    with_("qa")
    + """SELECT conv_id, turn, unnest(range(3)) AS position, unnest(['system', 'user', 'assistant']) AS role, unnest(['Answer briefly.', query, answer]) AS content FROM qa"""
)
def chat_messages(spark, d):
    qa = fixtures.qa_pairs(spark, d)
    turns = rendering.messages(F.lit("Answer briefly."), F.col("query"), F.col("answer"))
    out = qa.select("conv_id", "turn", F.posexplode(turns).alias("position", "m"))
    return out.select("conv_id", "turn", F.col("position").cast("long").alias("position"), "m.role", "m.content")


def _out(name: str, templates: list[str]) -> str:
    return with_("qa", outputs_sql(templates))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_META = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '<\|[^>]+?\|>', ' ', 'g'), '</?s>', ' ', 'g'), '\s+', ' ', 'g'))"
_CONTENT = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(" + _META + r", '(?i)</?(think|answer)>', ' ', 'g'), '(?i)^\s*(answer|final answer)\s*:\s*', ''), '\s+', ' ', 'g'))"
)


@query(
    _out("", fixtures.TAG_TEMPLATES)
    + ", s AS (SELECT conv_id, turn, "
    + _STRIP.format("raw_output")
    + r""" AS t FROM outs), p AS (SELECT conv_id, turn, t, regexp_extract(t, '(?is)<think>(.*?)</think>', 1) AS th, regexp_extract(t, '(?is)<answer>(.*?)</answer>', 1) AS an,
  regexp_matches(t, '(?is)<think>.*?</think>') AS ht, regexp_matches(t, '(?is)<answer>.*?</answer>') AS ha FROM s)
SELECT conv_id, turn, """
    + _CONTENT.format(r"CASE WHEN trim(th) <> '' THEN th WHEN ha THEN regexp_extract(t, '(?is)^(.*?)<answer>.*?</answer>', 1) ELSE '' END")
    + " AS thinking, "
    + _CONTENT.format(r"CASE WHEN trim(an) <> '' THEN an WHEN ht THEN regexp_replace(t, '(?is)^.*?<think>.*?</think>', '') ELSE t END")
    + " AS answer FROM p"
)
def parse_simple(spark, d):
    rows = outputs(spark, d, fixtures.TAG_TEMPLATES).withColumn("p", parsers.simple_output(F.col("raw_output")))
    return rows.select("conv_id", "turn", "p.thinking", "p.answer")


def _bracket_clean(x: str) -> str:
    for t in ("thinking_start", "thinking_end", "answer_start", "answer_end"):
        x = f"replace({x}, '[{t}]', ' ')"
    return _META.format(x)


_FIND = "strpos(r, '[{}]')"


@query(
    _out("", fixtures.BRACKET_TEMPLATES)
    + r""", x AS (SELECT conv_id, turn, raw_output AS r FROM outs),
p AS (SELECT *, regexp_extract(r, '(?s)\[thinking_start\](.*?)(\[thinking_end\]|$)', 1) AS th, regexp_extract(r, '(?s)\[answer_start\](.*?)(\[answer_end\]|$)', 1) AS an,
  strpos(r, '[thinking_end]') AS te, strpos(r, '[answer_start]') AS as_, strpos(r, '[answer_end]') AS ae FROM x),
c AS (SELECT conv_id, turn, CASE WHEN trim(th) <> '' THEN th WHEN te > 0 THEN substr(r, 1, te - 1) WHEN as_ > 1 THEN substr(r, 1, as_ - 1) ELSE '' END AS th,
  CASE WHEN trim(an) <> '' THEN an WHEN ae = 0 THEN '' ELSE regexp_replace(substr(r, 1, ae - 1), '(?s)^.*\[(answer_start|thinking_end|thinking_start)\]', '') END AS an FROM p)
SELECT conv_id, turn, """
    + _bracket_clean("th")
    + " AS thinking, "
    + _bracket_clean("an")
    + " AS answer FROM c"
)
def parse_bracket(spark, d):
    rows = outputs(spark, d, fixtures.BRACKET_TEMPLATES).withColumn("p", parsers.bracket_output(F.col("raw_output")))
    return rows.select("conv_id", "turn", "p.thinking", "p.answer")


_BOLDLESS = "trim(regexp_replace(replace(" + _CONTENT + r", '**', ' '), '\s+', ' ', 'g'))"
_QUOTED = "' ' || chr(9) || chr(10) || chr(13) || '\"''`'"
_FIELD = "trim(trim(regexp_replace(replace(" + _META + r", '**', ' '), '\s+', ' ', 'g')), " + _QUOTED + ")"
_LINES = "list_filter(list_transform(string_split({}, chr(10)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '')"


def _final_sql(x: str) -> str:
    """STR-11 of an SQL expression: its last bold span or all of it, cleaned, without a label and quotes."""
    bold = f"regexp_extract_all({x}, '(?s)\\*\\*(.+?)\\*\\*', 1)"
    c = _BOLDLESS.format(f"coalesce({bold}[-1], {x})")
    c = f"regexp_replace(regexp_replace({c}, '^#+\\s*', ''), '(?i)^\\s*(?:answer|final answer)\\s*[:\\-]\\s*', '')"
    c = f"trim(trim({c}), {_QUOTED})"
    return f"CASE WHEN regexp_matches({c}, '(?i)^(facts|bridge|check)\\s*:') THEN '' ELSE {c} END"


def _expected(templates: list[str], cases: list[tuple[str, str, str]]) -> str:
    """Per template the thinking and the answer (SQL over query q and answer a) and the method that its outputs must give."""
    pick = lambda i: " ".join(f"WHEN {k} THEN {c[i]}" for k, c in enumerate(cases))
    return with_("qa", outputs_sql(templates)) + f""", o AS (SELECT *, query AS q, answer AS a, (conv_id * 8 + turn) % {len(templates)} AS k FROM outs),
e AS (SELECT *, CASE k {pick(0)} END AS th, CASE k {pick(1)} END AS an, CASE k {pick(2)} END AS how FROM o)
"""


_LAST = f"{_LINES.format('a')}[-1]"
_NATIVE = _expected(
    fixtures.NATIVE_TEMPLATES,
    [
        ("q", "a", "'native_answer_tokens+think_tag'"),
        ("q", "a", "'plain_answer_tokens+native_thinking_tokens'"),
        ("q", "a", "'native_thinking_start_only+native_answer_start_only'"),
        ("''", "a", "'plain_answer_tokens'"),
        ("''", "a", "'answer_tag'"),
        ("''", "a", "'answer_marker'"),
        (f"array_to_string({_LINES.format('q || chr(10) || a')}[:-2], ' ')", _LAST, "'last_line_fallback'"),
        ("''", "''", "'none'"),
    ],
)


@query(_NATIVE + f"SELECT conv_id, turn, {_FIELD.format('th')} AS thinking, {_FIELD.format('an')} AS answer, {_FIELD.format('an')} <> '' AS parse_ok, how AS parse_method FROM e")
def parse_native(spark, d):
    rows = outputs(spark, d, fixtures.NATIVE_TEMPLATES).withColumn("p", parsers.native_column(F.col("raw_output")))
    return rows.select("conv_id", "turn", "p.*")


@query(
    _out("", fixtures.NATIVE_TEMPLATES + ["<think>{q} <|answer_start|>{a}", "<think> {q} </think>{a}"])
    + "SELECT conv_id, turn, "
    + _META.format(
        r"CASE WHEN regexp_matches(raw_output, '(?is)<think>.*?</think>') THEN regexp_extract(raw_output, '(?is)<think>(.*?)</think>', 1) ELSE regexp_replace(regexp_extract(raw_output, '(?is)<think>\s*(.*)$', 1), '(?is)(</think>|<\|answer_start\|>|<answer_start>|\[answer_start\]).*$', '') END"
    )
    + " AS thinking FROM outs"
)
def think_extract(spark, d):
    rows = outputs(spark, d, fixtures.NATIVE_TEMPLATES + ["<think>{q} <|answer_start|>{a}", "<think> {q} </think>{a}"])
    return rows.select("conv_id", "turn", parsers.think_text(F.col("raw_output")).alias("thinking"))


@query(
    _out("", fixtures.TAG_TEMPLATES)
    + ", m AS (SELECT conv_id, turn, "
    + _META.format("raw_output")
    + r""" AS t FROM outs)
SELECT conv_id, turn, regexp_matches(t, '(?s)^.*?<think>.*?</think>')::INT * regexp_matches(t, '(?s)^[^<]*<think>[^<]*</think>[^<]*<answer>[^<]*</answer>')::INT AS format_ok,
  trim(regexp_extract(t, '(?s)<think>(.*?)</think>', 1)) AS thinking, trim(regexp_extract(t, '(?s)<answer>(.*?)</answer>', 1)) AS answer FROM m"""
)
def format_check(spark, d):
    rows = outputs(spark, d, fixtures.TAG_TEMPLATES).withColumn("p", parsers.ordered_tags(F.col("raw_output")))
    return rows.select("conv_id", "turn", "p.format_ok", "p.thinking", "p.answer")


@query(_out("", fixtures.BRACKET_TEMPLATES) + "SELECT conv_id, turn, split_part(raw_output, '[answer_end]', 1) AS cut FROM outs")
def cut_at_end(spark, d):
    return outputs(spark, d, fixtures.BRACKET_TEMPLATES).select("conv_id", "turn", cut_at(F.col("raw_output"), "[answer_end]").alias("cut"))


_CASCADE = (
    _expected(
        fixtures.CASCADE_TEMPLATES,
        [
            ("q", "a", "'answer_tag'"),
            ("q", "a", "'qwen3_answer_tokens'"),
            ("q", "a", "'plain_answer_tokens'"),
            ("q", "a", "'qwen3_answer_start_only'"),
            ("q", "a", "'answer_open_tag_tail'"),
            ("q", "a", "'answer_marker_tail'"),
            ("q", _LAST, "'tail_last_line'"),
            ("q", "a", "'final_answer_xml'"),
            ("q", "string_split(a, chr(10))[1]", "'final_answer_line'"),
            ("q", "a", "'answer_marker'"),
            ("q", "a", "'standalone_bold_line'"),
            ("q || ' so '", "a", "'last_bold_span'"),
            (f"array_to_string({_LINES.format('q || chr(10) || a')}[:-2], ' ')", _LAST, "'last_line_fallback'"),
            ("''", "''", "'unknown'"),
        ],
    )
    + f""", clean AS (SELECT * EXCLUDE (th, an), {_BOLDLESS.format('th')} AS th, {_final_sql('an')} AS an FROM e),
p AS (SELECT conv_id, turn, query, reference_answer, prompt_version, raw_output, array_to_string(list_filter(string_split(th, ' '), lambda x: x <> '')[1:256], ' ') AS thinking,
  CASE WHEN lower(th) = lower(an) THEN '' ELSE an END AS answer, an <> '' AND lower(th) <> lower(an) AS parse_ok,
  CASE WHEN an <> '' AND lower(th) = lower(an) THEN 'unknown' ELSE how END AS parse_method FROM clean)
"""
)


def _policy_sql(fallback: bool) -> str:
    gold = _STRIP.format("reference_answer")
    inside = f"{gold} <> '' AND contains(lower({_META.format('raw_output')}), lower({gold}))"
    filled = f"{gold} <> ''" if fallback else "false"
    return (
        _CASCADE
        + f""", filled AS (SELECT *, CASE WHEN answer = '' AND ({inside}) THEN {gold} WHEN answer = '' AND {filled} THEN {gold} ELSE answer END AS final,
  CASE WHEN answer = '' AND ({inside}) THEN 'reference_substring_match' WHEN answer = '' AND {filled} THEN 'fallback_reference_answer' ELSE parse_method END AS how FROM p),
judged AS (SELECT *, CASE WHEN final = '' THEN 'empty_answer' WHEN thinking = '' THEN 'empty_thinking' END AS reason FROM filled)
"""
    )


def _cascade(spark, d):
    return outputs(spark, d, fixtures.CASCADE_TEMPLATES).withColumn("p", parsers.cascade_column(F.col("raw_output"), 256))


@query(_CASCADE + "SELECT conv_id, turn, thinking, answer, parse_ok, parse_method FROM p")
def parse_cascade(spark, d):
    return _cascade(spark, d).select("conv_id", "turn", "p.*")


@query(_CASCADE + "SELECT parse_method, count(*) AS n, count(*) FILTER (parse_ok) AS ok FROM p GROUP BY 1")
def parse_method_counts(spark, d):
    return _cascade(spark, d).groupBy(F.col("p.parse_method").alias("parse_method")).agg(F.count("*").alias("n"), F.count_if("p.parse_ok").alias("ok"))


def _policy(spark, d, fallback=False):
    rows = _cascade(spark, d)
    return rows.withColumn("policy", parsers.answer_policy(F.col("p"), F.col("raw_output"), F.col("reference_answer"), fallback=fallback))


def _policy_rows(rows):
    return rows.select("conv_id", "turn", F.col("policy.answer").alias("answer"), F.col("policy.parse_method").alias("parse_method"), F.col("policy.reason").alias("reason"))


@query(_policy_sql(False) + "SELECT conv_id, turn, final AS answer, how AS parse_method, reason FROM judged")
def parse_policy(spark, d):
    return _policy_rows(_policy(spark, d))


@query(_policy_sql(True) + "SELECT conv_id, turn, final AS answer, how AS parse_method, reason FROM judged")
def parse_policy_fallback(spark, d):
    return _policy_rows(_policy(spark, d, fallback=True))


@query(
    _policy_sql(False)
    + "SELECT reason, query, reference_answer, prompt_version, parse_method, raw_output, thinking AS parsed_thinking, answer AS parsed_answer FROM judged WHERE reason IS NOT NULL"
)
def dead_letters(spark, d):
    rows = _policy(spark, d).where("policy.reason IS NOT NULL")
    return rows.select(
        F.col("policy.reason").alias("reason"), "query", "reference_answer", "prompt_version", F.col("p.parse_method").alias("parse_method"), "raw_output",
        F.col("p.thinking").alias("parsed_thinking"), F.col("p.answer").alias("parsed_answer"),
    )


@query(
    _out("", fixtures.JSON_TEMPLATES)
    + r""", j AS (SELECT conv_id, turn, regexp_extract(raw_output, '(?s)\{.*\}') AS o FROM outs) SELECT conv_id, turn, CASE WHEN json_valid(o) THEN json(o)::VARCHAR END AS object FROM j"""
)
def json_extract(spark, d):
    return outputs(spark, d, fixtures.JSON_TEMPLATES).select("conv_id", "turn", parsers.json_column(F.col("raw_output")).alias("object"))


_TRACES = (
    _out("", fixtures.CASCADE_TEMPLATES)
    + """, traces AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 2 THEN '  ' ELSE query END AS query, answer AS context, CASE WHEN turn % 5 = 3 THEN '' ELSE query END AS thinking,
  answer, reference_answer, prompt_version, raw_output FROM outs)
"""
)


def _traces(spark, d):
    rows = outputs(spark, d, fixtures.CASCADE_TEMPLATES)
    blank = F.pmod("conv_id", F.lit(11)) == 2
    return rows.select(
        "conv_id", "turn", F.when(blank, "  ").otherwise(F.col("query")).alias("query"), F.col("answer").alias("context"),
        F.when(F.pmod("turn", F.lit(5)) == 3, "").otherwise(F.col("query")).alias("thinking"), "answer", "reference_answer", "prompt_version", "raw_output",
    )


@query(
    _TRACES
    + """, c AS (SELECT count(*) AS a, count(*) FILTER (trim(query) <> '') AS b, count(*) FILTER (trim(query) <> '' AND thinking <> '') AS c,
  count(*) FILTER (trim(query) <> '' AND thinking <> '' AND reference_answer = answer) AS d FROM traces)
SELECT unnest([0, 1, 2, 3]) AS stage_no, unnest(['before', 'after_non_empty', 'after_thinking', 'after_correct']) AS stage, unnest([a, b, c, d]) AS rows FROM c"""
)
def quality_filter_stages(spark, d):
    return filters.stage_counts(_traces(spark, d))


@query(_TRACES + "SELECT conv_id, turn, prompt_version FROM traces WHERE prompt_version IN ('v1', 'v4')")
def prompt_version_filter(spark, d):
    return filters.prompt_versions(_traces(spark, d), ["v1", "v4"]).select("conv_id", "turn", "prompt_version")


@query(with_("qa") + r"SELECT conv_id, turn FROM qa WHERE len(list_filter(regexp_split_to_array(query || ' ' || answer, '\s+'), lambda x: x <> '')) < 60 - 1")
def length_filter(spark, d):
    qa = fixtures.qa_pairs(spark, d)
    return filters.short_enough(qa, F.concat_ws(" ", "query", "answer"), 60).select("conv_id", "turn")


_IDS = "list_transform(range(1, 41), lambda i: (conv_id * 7 + i)::INT)"


@query(
    with_("qa")
    + f"""SELECT conv_id, turn, list_transform(range(1, 41), lambda i: CASE WHEN i - 1 < length(query) % 50 OR i > 30 THEN -100 ELSE ({_IDS})[i] END)::INT[]::VARCHAR AS labels FROM qa"""
)
def label_mask(spark, d):
    qa = fixtures.qa_pairs(spark, d)
    ids = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: (F.col("conv_id") * 7 + i).cast("int"))
    mask = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: (i <= 30).cast("int"))
    labels = filters.masked_labels(ids, mask, F.pmod(F.length("query"), F.lit(50)))
    return qa.select("conv_id", "turn", F.concat(F.lit("["), F.array_join(labels.cast("array<string>"), ", "), F.lit("]")).alias("labels"))


@query(
    "SELECT page_id, url, length(html) AS html_chars FROM pages WHERE regexp_replace(url, '^\\s+|\\s+$', '', 'g') <> ''"
)
def required_fields(spark, d):
    rows = filters.non_empty(table(spark, d, "pages"), ["url"])
    return rows.select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


