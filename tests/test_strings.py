import re
import string

import pytest
from pyspark.sql import functions as F

from qaflow.functions import strings as S

TEXTS = [
    None, "", "  ", "\t a\xa0b \x1c", "　wide　", "a  b\nc", "The Answer: an apple, a day!", "réa b", "à la carte", "x" * 30, "**one** and **two**",
    "### Answer: 'final'", "Facts: none", "I can't find the answer in the context", "I don’t know", "i dont know", "No relevant context", "<|im_start|> hi </s> there",
    "<think>x</think> Answer: y", "line one\r\nline two\n\n", "Yes", "0", "t", "😀 emoji", "a/b/c.parquet/", "out.rank3", "[s]in[e]out",
]


def column(spark, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def plain_answer(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


CASES = {
    "strip": (S.strip, str.strip),
    "collapse": (S.collapse, lambda s: " ".join(s.split())),
    "normalize_text": (S.normalize_text, lambda s: " ".join(s.lower().split())),
    "truncate_chars": (lambda c: S.truncate_chars(c, 5), lambda s: s.strip() if len(s.strip()) <= 5 else s.strip()[:5].rstrip()),
    "truncate_words": (lambda c: S.truncate_words(c, 2), lambda s: " ".join(s.split()[:2])),
    "truncate_no_words": (lambda c: S.truncate_words(c, 0), str.strip),
    "words": (S.words, str.split),
    "last_line": (S.last_line, lambda s: next((x.strip() for x in reversed(s.splitlines()) if x.strip()), "")),
    "normalize_answer": (S.normalize_answer, plain_answer),
    "strip_meta": (S.strip_meta, lambda s: " ".join(re.sub(r"</?s>", " ", re.sub(r"<\|[^>]+?\|>", " ", s)).split())),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_python(spark, name):
    expression, python = CASES[name]
    assert column(spark, expression) == [python(t or "") for t in TEXTS]


def test_answers(spark):
    found = dict(zip(TEXTS, column(spark, S.normalize_answer_text)))
    assert found["**one** and **two**"] == "two" and found["### Answer: 'final'"] == "final" and found["Facts: none"] == "" and found[None] == ""
    canonical = dict(zip(TEXTS, column(spark, S.canonical_answer)))
    assert canonical["I can't find the answer in the context"] == S.IDK and canonical["No relevant context"] == S.NO_CONTEXT and canonical["Yes"] == "Yes"
    dotted = "I can't find the answer in the context."
    df = spark.createDataFrame([(dotted,)], "t string")
    assert df.select(S.canonical_answer(F.col("t"))).first()[0] == dotted  # the dotted form is known only where configured
    assert df.select(S.canonical_answer(F.col("t"), extra_idk=(dotted,))).first()[0] == S.IDK


def test_small_functions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert [one(S.to_bool(F.lit(v), k)) for v, k in ((" Yes ", "string"), ("no", "string"), (0.5, "double"), (None, "int"), (True, "boolean"))] == [True, False, True, False, True]
    assert one(S.csv_items(F.lit(" a, ,b ,"))) == ["a", "b"]
    assert one(S.run_name_number(F.lit("-1.5e-05"))) == "m1p5em05"
    assert [one(S.output_dir(F.lit(x))) for x in ("a/b/", "a/b/part.parquet", "a/out.rank3")] == ["a/b", "a/b", "a/out"]
    assert [one(S.between(F.lit(x), "[s]", "[e]")) for x in ("[s] in [e] out", "no", "[s] open")] == ["in", "", "open"]
    assert one(S.contains_answer(F.lit("It is <|x|> Paris."), F.lit(" paris "))) and not one(S.contains_answer(F.lit("x"), F.lit("")))
    assert one(S.cut_at(F.lit("a[e]b[e]"), "[e]")) == "a"
    assert one(S.free_text_refusal(F.lit("I don't know, sorry"), "IDK")) == "IDK"


def test_ratios():
    assert S.parse_ratios("a:3, b:1", ("a", "b", "c")) == {"a": 0.75, "b": 0.25, "c": 0.0}
    for bad in ("d:1", "a:0"):
        with pytest.raises(ValueError):
            S.parse_ratios(bad, ("a", "b"))


def test_ratio_shares(spark):
    import pytest
    from pyspark.sql import functions as F

    from qaflow.functions.strings import parse_ratios, ratio_shares

    classes = ("a", "b", "c")
    specs = ["a:1,b:3", " a : 2 ,, c:2", "a:1,a:4,b:1", "a:0", "", "b:2.5"]
    rows = spark.createDataFrame([(s,) for s in specs], "s string").select("s", ratio_shares(F.col("s"), classes).alias("shares")).collect()
    for r in rows:
        try:
            expected = parse_ratios(r["s"], classes)
        except ValueError:
            expected = None
        assert r["shares"] == expected, r["s"]
    with pytest.raises(Exception, match="unknown classes d"):
        spark.createDataFrame([("a:1,d:2",)], "s string").select(ratio_shares(F.col("s"), classes)).collect()
