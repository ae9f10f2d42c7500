"""Parsers of structured model outputs, all Column expressions: rows never leave the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaflow.functions.strings import (
    SPACE,
    SPECIAL,
    between,
    clean_content,
    contains_answer,
    let,
    lines,
    normalize_answer_text,
    normalize_field,
    strip,
    strip_meta,
    text,
    truncate_words,
)


def _pos(c: Column, sub: str, start: Column | int = 1) -> Column:
    """1-based position of ``sub`` from ``start``; 0 if absent."""
    return F.call_function("locate", F.lit(sub), c, start if isinstance(start, Column) else F.lit(start))


def _last_pos(c: Column, sub: str) -> Column:
    """1-based position of the last ``sub``; 0 if absent."""
    back = F.locate(sub[::-1], F.reverse(c))
    return F.when(back == 0, 0).otherwise(F.length(c) - back - len(sub) + 2)


def _head(c: Column, n: Column) -> Column:
    return F.substring(c, F.lit(1), n)


def _tail(c: Column, start: Column) -> Column:
    return F.substring(c, start, F.length(c))


def _or(*choices: Column) -> Column:
    """The first non-empty choice, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


@dataclass(frozen=True)
class Markers:
    thinking_start: str = "[thinking_start]"
    thinking_end: str = "[thinking_end]"
    answer_start: str = "[answer_start]"
    answer_end: str = "[answer_end]"

    @property
    def all(self) -> tuple[str, ...]:
        return (self.thinking_start, self.thinking_end, self.answer_start, self.answer_end)


def _without_markers(c: Column, m: Markers) -> Column:
    for mark in m.all:
        c = F.replace(c, F.lit(mark), F.lit(" "))
    return strip_meta(c)


def bracket_output(raw: Column, m: Markers = Markers()) -> Column:
    """struct<thinking, answer> of bracket-token output, with the fall-backs for missing tokens."""
    raw = text(raw)
    t_start, t_end, a_start = _pos(raw, m.thinking_start), _pos(raw, m.thinking_end), _pos(raw, m.answer_start)
    prefix = F.when(t_end > 0, strip(_head(raw, t_end - 1))).when(a_start > 1, strip(_head(raw, a_start - 1))).otherwise(F.lit(""))
    begin = t_start + len(m.thinking_start)
    inner = F.when((t_start > 0) & (a_start > t_start), strip(F.substring(raw, begin, F.greatest(a_start - begin, F.lit(0))))).otherwise(F.lit(""))
    thinking = _or(between(raw, m.thinking_start, m.thinking_end), prefix, inner)
    close = _last_pos(raw, m.answer_end)
    before = _head(raw, close - 1)
    opened = [(mark, _last_pos(before, mark)) for mark in (m.answer_start, m.thinking_end, m.thinking_start)]
    cut = F.when(close == 0, F.lit(""))
    for mark, at in opened:
        cut = cut.when(at > 0, strip(_tail(before, at + len(mark))))
    tail = F.when(a_start > 0, strip(_tail(raw, a_start + len(m.answer_start)))).otherwise(F.lit(""))
    answer = _or(between(raw, m.answer_start, m.answer_end), cut.otherwise(strip(before)), tail)
    return F.struct(_without_markers(thinking, m).alias("thinking"), _without_markers(answer, m).alias("answer"))


@dataclass(frozen=True)
class Tags:
    think_open: str = "<think>"
    think_close: str = "</think>"
    answer_start: str = "<answer>"
    answer_end: str = "</answer>"


def ordered_tags(completion: Column, t: Tags = Tags()) -> Column:
    """struct<format_ok, thinking, answer>: all four tags must come in order; special tokens are dropped first."""
    c = strip_meta(completion)
    a = _pos(c, t.think_open)
    b = F.when(a > 0, _pos(c, t.think_close, a + len(t.think_open))).otherwise(F.lit(0))
    d = _pos(c, t.answer_start)
    e = F.when(d > 0, _pos(c, t.answer_end, d + len(t.answer_start))).otherwise(F.lit(0))
    ok = (a > 0) & (b > a) & (d > b) & (e > d)
    cut = lambda i, j, opening: F.when((i > 0) & (j > i), strip(F.substring(c, i + len(opening), j - i - len(opening)))).otherwise(F.lit(""))
    return F.struct(ok.cast("int").alias("format_ok"), cut(a, b, t.think_open).alias("thinking"), cut(d, e, t.answer_start).alias("answer"))


def think_text(raw: Column) -> Column:
    """The think span's text; of an unclosed one the text up to the first stop marker; '' without."""
    raw = text(raw)
    opened = F.regexp_extract(raw, "(?is)<think>\\s*(.*)$", 1)
    cut = F.regexp_replace(opened, "(?is)(</think>|<\\|answer_start\\|>|<answer_start>|\\[answer_start\\]).*$", "")
    closed = F.regexp_extract(raw, "(?is)<think>(.*?)</think>", 1)
    return strip_meta(F.when(raw.rlike("(?is)<think>.*?</think>"), closed).otherwise(cut))


def simple_output(raw: Column, max_words: int = 0) -> Column:
    """struct<thinking, answer> of think/answer tags: without an answer, what follows the think span, or the whole text."""
    s = strip(raw)
    has_think, has_answer = s.rlike("(?is)<think>.*?</think>"), s.rlike("(?is)<answer>.*?</answer>")
    after = strip(F.regexp_replace(s, "(?is)^.*?<think>.*?</think>", ""))
    answer = _or(strip(F.regexp_extract(s, "(?is)<answer>(.*?)</answer>", 1)), F.when(has_think, after).otherwise(s))
    before = F.when(has_answer, F.regexp_extract(s, "(?is)^(.*?)<answer>.*?</answer>", 1)).otherwise(F.lit(""))
    thinking = _or(strip(F.regexp_extract(s, "(?is)<think>(.*?)</think>", 1)), clean_content(before, bold=False))
    return F.struct(
        truncate_words(clean_content(thinking, bold=False), max_words).alias("thinking"), clean_content(answer, bold=False).alias("answer")
    )


# --- outputs whose format isn't known: tables of candidates, in order of preference ---


def _found(c: Column, pattern: str, body, last: bool = False) -> Column:
    """``body`` of the first (or last) match of ``pattern`` in ``c``: a struct of its only group and the text before and after it. Null without a match.

    The matches are bound once, and only looked for where there is one; ``c`` should be a bound value too.
    """
    p = F.lit(pattern)
    parts = F.struct(F.regexp_extract_all(c, p, 0).alias("whole"), F.regexp_extract_all(c, p, 1).alias("inner"), F.split(c, pattern, -1).alias("between"))
    at = -1 if last else 1

    def cut(m: Column) -> Column:
        whole = F.element_at(m["whole"], at)
        before = _head(c, F.length(c) - F.length(F.element_at(m["between"], -1)) - F.length(whole)) if last else F.get(m["between"], 0)
        after = _tail(c, F.length(F.get(m["between"], 0)) + F.length(F.get(m["whole"], 0)) + 1)
        return F.struct(F.element_at(m["inner"], at).alias("value"), before.alias("before"), after.alias("after"))

    return F.when(c.rlike(pattern), let(parts, lambda m: let(cut(m), body)))


#: How the output formats mark their parts. "." stops at a line feed only where (?s) is missing.
_W = f"{SPACE}*"
_THINK = "(?is)<think>(.*?)</think>"
_TAG = "(?is)<answer>(.*?)</answer>"
_NATIVE = f"(?is)<\\|answer_start\\|>{_W}(.*?){_W}<\\|answer_end\\|>"
_NATIVE_OPEN = f"(?is)<\\|answer_start\\|>{_W}(.*)\\z"
_PLAIN = f"(?is)<answer_start>{_W}(.*?){_W}<answer_end>"
_PLAIN_SLASH = f"(?is)<answer_start>{_W}(.*?){_W}</?answer_end>"
_PLAIN_OPEN = f"(?is)<answer_start>{_W}(.*)\\z"
_TAG_OPEN = f"(?is)<answer>{_W}(.*)\\z"
_MARKER = f"(?is)(?:^|\n){_W}(?:final{SPACE}+answer|answer){_W}[:\\-]{_W}(.+)"
_FINAL_XML = f"(?is)###{_W}<final answer>{_W}(.*?){_W}</final answer>"
_FINAL_LINE = f"(?id)(?:^|\n){_W}final{SPACE}+answer{_W}[:\\-]{_W}(.+)"
_BOLD_LINE = f"(?s)(?:^|\n){_W}\\*\\*(.+?)\\*\\*{_W}(?=\n|\\z)"
_BOLD = "(?s)\\*\\*(.+?)\\*\\*"
_NATIVE_THINK = f"(?is)<\\|thinking_start\\|>{_W}(.*?){_W}<\\|thinking_end\\|>"
_NATIVE_THINK_OPEN = f"(?is)<\\|thinking_start\\|>{_W}(.*?){_W}(?=<\\|answer_start\\|>|<answer_start>|\\z)"


def _candidate(name: str, value: Column, **more: Column) -> Column:
    return F.struct(strip(value).alias("value"), F.lit(name).alias("name"), *[c.alias(k) for k, c in more.items()])


def _last_line(lines_: Column, body) -> Column:
    """``body`` of the last line and of the ones before it, joined; null without lines."""
    earlier = F.array_join(F.slice(lines_, F.lit(1), F.greatest(F.size(lines_) - 1, F.lit(0))), " ")
    return F.when(F.size(lines_) > 0, body(F.try_element_at(lines_, F.lit(-1)), earlier))


def _parsed(thinking: Column, answer: Column, method: Column) -> Column:
    return F.struct(thinking.alias("thinking"), answer.alias("answer"), (answer != "").alias("parse_ok"), method.alias("parse_method"))


def cascade_column(raw: Column, max_words: int = 0) -> Column:
    """struct<thinking, answer, parse_ok, parse_method> of a free-form reasoning output.

    Candidates for the answer stand in groups, in order of preference. A group offers its first match; the groups are folded
    from the left, and a group counts only while the answer is empty (or, for ``overrides``, at all). ``head`` is the text
    before a match: that of the raw output becomes the thinking at once, that of the plain text only if nothing else does.
    """
    no = F.lit("")

    def of_raw(r: Column) -> Column:
        return let(strip(F.regexp_replace(r, SPECIAL, " ")), lambda t: let(parts_of(t), lambda parts: fold(r, t, parts)))

    def parts_of(t: Column) -> Column:
        """What several groups look at: the thinking, the text up to its end and after it, the lines, and what an answer tag has before it."""
        think = _found(t, _THINK, lambda m: F.struct(strip(m["value"]).alias("thought"), strip(m["after"]).alias("tail"), _head(t, F.length(t) - F.length(m["after"])).alias("till")))
        return F.struct(think.alias("think"), lines(t).alias("lines"), _found(t, _TAG, lambda m: clean_content(m["before"])).alias("tag_head"))

    def fold(r: Column, t: Column, parts: Column) -> Column:
        tail, till = parts["think"]["tail"], parts["think"]["till"]

        def group(*choices: Column, overrides: bool = False, untagged: bool = False) -> Column:
            return F.struct(F.coalesce(*choices).alias("pick"), F.lit(overrides).alias("overrides"), F.lit(untagged).alias("untagged"))

        def plain(name: str, pattern: str, last: bool = False, marks_thinking: bool = False) -> Column:
            return _found(t, pattern, lambda m: _candidate(name, m["value"], now=clean_content(m["before"]) if marks_thinking else no, head=m["before"]), last)

        def in_tail(name: str, pattern: str) -> Column:
            return _found(tail, pattern, lambda m: _candidate(name, m["value"], now=no, head=F.concat(till, m["before"])))

        def tokens(name: str, pattern: str) -> Column:
            return _found(r, pattern, lambda m: _candidate(name, m["value"], now=clean_content(m["before"]), head=no))

        groups = [
            group(plain("answer_tag", _TAG)),
            group(tokens("qwen3_answer_tokens", _NATIVE), overrides=True),
            group(tokens("plain_answer_tokens", _PLAIN)),
            group(tokens("qwen3_answer_start_only", _NATIVE_OPEN)),
            group(
                in_tail("answer_open_tag_tail", _TAG_OPEN),
                in_tail("answer_marker_tail", _MARKER),
                let(lines(tail), lambda x: _last_line(x, lambda line, _: _candidate("tail_last_line", line, now=no, head=till))),
            ),
            group(plain("final_answer_xml", _FINAL_XML)),
            group(plain("final_answer_line", _FINAL_LINE, last=True)),
            group(
                plain("answer_marker", _MARKER, marks_thinking=True),
                plain("standalone_bold_line", _BOLD_LINE, last=True),
                plain("last_bold_span", _BOLD, last=True),
                untagged=True,
            ),
            group(_last_line(parts["lines"], lambda line, earlier: _candidate("last_line_fallback", line, now=earlier, head=no)), untagged=True),
        ]
        tagged = parts["tag_head"].isNotNull()

        def step(best: Column, g: Column) -> Column:
            hit = g["pick"].isNotNull() & (g["overrides"] | (best["value"] == "")) & ~(g["untagged"] & tagged)
            put = lambda f: F.when(hit, g["pick"][f]).otherwise(best[f])
            now = F.when(hit & (best["now"] == ""), g["pick"]["now"]).otherwise(best["now"])
            return F.struct(put("value").alias("value"), put("name").alias("name"), now.alias("now"), put("head").alias("head"))

        nothing = F.struct(no.alias("value"), no.alias("name"), F.coalesce(parts["think"]["thought"], no).alias("now"), no.alias("head"))
        best = F.aggregate(F.array(*groups), nothing, step)
        return let(best, lambda b: finish(b["value"], b["name"], clean_content(_or(b["now"], parts["tag_head"], b["head"]))))

    def finish(value: Column, name: Column, thinking: Column) -> Column:
        return let(F.struct(thinking.alias("t"), normalize_answer_text(value).alias("a")), lambda x: unless_equal(x["t"], x["a"], name))

    def unless_equal(thinking: Column, answer: Column, name: Column) -> Column:
        same = (answer != "") & (F.lower(thinking) == F.lower(answer))
        kept = F.when(same, no).otherwise(answer)
        short = truncate_words(thinking, max_words) if max_words > 0 else thinking
        return _parsed(short, kept, F.when(same | (name == ""), F.lit("unknown")).otherwise(name))

    return let(strip(F.regexp_replace(text(raw), "</?s>", " ")), of_raw)


def native_column(raw: Column, accept_slash: bool = True) -> Column:
    """struct<thinking, answer, parse_ok, parse_method> of native-token output; methods of both fields are joined by "+".

    Candidates of either field are folded in order of preference while the field is empty. A match names itself in the method
    ``always``, or only if the method is empty yet (``first``); an ``only`` candidate counts only if it is empty yet.
    ``accept_slash`` also takes ``</answer_end>`` as the closing token of a plain answer.
    """

    def of(r: Column, rest: Column) -> Column:
        pick = lambda how, name, pattern: F.struct(_found(r, pattern, lambda m: _candidate(name, m["value"])).alias("pick"), F.lit(how).alias("how"))
        spans = [pick("only", "native_answer_tokens", _NATIVE), pick("only", "plain_answer_tokens", _PLAIN_SLASH if accept_slash else _PLAIN)]
        thoughts = [
            pick("always", "think_tag", _THINK),
            pick("always", "native_thinking_tokens", _NATIVE_THINK),
            pick("always", "native_thinking_start_only", _NATIVE_THINK_OPEN),
        ]
        open_ = [
            pick("always", "native_answer_start_only", _NATIVE_OPEN),
            pick("always", "plain_answer_start_only", _PLAIN_OPEN),
            pick("first", "answer_tag", _TAG),
            pick("first", "answer_marker", _MARKER),
        ]
        line = [F.struct(_last_line(rest, lambda x, _: _candidate("last_line_fallback", x)).alias("pick"), F.lit("first").alias("how"))]

        def step(best: Column, c: Column) -> Column:
            unnamed = F.size(best["names"]) == 0
            hit = c["pick"].isNotNull() & (best["value"] == "") & ((c["how"] != "only") | unnamed)
            names = F.when(hit & ((c["how"] == "always") | unnamed), F.array_append(best["names"], c["pick"]["name"])).otherwise(best["names"])
            return F.struct(F.when(hit, c["pick"]["value"]).otherwise(best["value"]).alias("value"), names.alias("names"))

        def fold(candidates: list[Column], value: Column, names: Column) -> Column:
            return F.aggregate(F.array(*candidates), F.struct(value.alias("value"), names.alias("names")), step)

        def done(thought: Column, answer: Column, last: Column) -> Column:
            by_line = (answer["value"] == "") & (F.size(rest) > 0)
            thinking = F.when(by_line, _or(thought["value"], _last_line(rest, lambda _, earlier: earlier))).otherwise(thought["value"])
            method = F.when(F.size(last["names"]) == 0, F.lit("none")).otherwise(F.array_join(last["names"], "+"))
            return let(normalize_field(last["value"]), lambda a: _parsed(normalize_field(thinking), a, method))

        def then(start: Column, candidates: list[Column], body, value: Column | None = None) -> Column:
            return let(fold(candidates, start["value"] if value is None else value, start["names"]), body)

        empty = F.struct(F.lit("").alias("value"), F.array().cast("array<string>").alias("names"))
        return then(empty, spans, lambda s: then(s, thoughts, lambda t: then(t, open_, lambda a: then(a, line, lambda z: done(t, a, z)), s["value"]), F.lit("")))

    return let(text(raw), lambda r: let(lines(r), lambda rest: of(r, rest)))


def json_column(raw: Column) -> Column:
    """The text from the first "{" to the last "}" if it is one strict JSON object, with sorted keys and no blanks; else null. Repeated keys aren't strict."""
    # in an array, as text after a complete value would be left unread
    listed = F.try_parse_json(F.concat(F.lit("["), F.nullif(F.regexp_extract(text(raw), "(?s)(\\{.*\\})", 1), F.lit("")), F.lit("]")))
    return let(listed.cast("array<variant>"), lambda x: F.when(F.size(x) == 1, F.to_json(F.get(x, 0))))


def answer_policy(parsed: Column, raw: Column, reference: Column, fallback: bool = True, allow_empty_thinking: bool = False) -> Column:
    """struct<answer, parse_method, reason>: an empty answer becomes the reference where the output contains it, or by ``fallback``; else the row is rejected."""
    gold = strip(reference)
    empty = parsed["answer"] == ""
    inside = empty & contains_answer(raw, gold)
    filled = empty & ~inside & F.lit(fallback) & (gold != "")
    answer = F.when(inside | filled, gold).otherwise(parsed["answer"])
    method = F.when(inside, "reference_substring_match").when(filled, "fallback_reference_answer").otherwise(parsed["parse_method"])
    reason = F.when(answer == "", "empty_answer").when((parsed["thinking"] == "") & F.lit(not allow_empty_thinking), "empty_thinking")
    return F.struct(answer.alias("answer"), method.alias("parse_method"), reason.alias("reason"))
