import json

import pytest
from pyspark.sql import functions as F

from qaflow.functions import metadata as m
from qaflow.operators import validation

DOC = {"i": 5, "big": 2**62, "f": 1.5, "e": 1e300, "s": "5", "t": True, "n": None, "a": [1, "x", None, [2]], "o": {"i": 7, "deep": {"s": "é"}}, "empty": {}}


@pytest.mark.parametrize(
    "path,kind",
    [("$.i", "integer"), ("$.big", "integer"), ("$.f", "number"), ("$.e", "number"), ("$.s", "string"), ("$.t", "boolean"), ("$.n", "null"), ("$.a", "array"), ("$.o", "object"),
     ("$.o.deep.s", "string"), ("$.x", "missing"), ("$.i.x", "missing"), ("$.a.x", "missing"), ("$.a[1]", "string"), ("$.a[9]", "missing"), ("$.empty", "object"), ("$.n.x", "missing")],
)
def test_kinds(spark, path, kind):
    assert spark.createDataFrame([(json.dumps(DOC),)], "t string").select(m.kind(m.document(F.col("t")), path)).first()[0] == kind


def test_values_and_defaults(spark):
    doc = m.document(F.col("t"))
    asked = {
        ("$.i", "integer", 0): 5, ("$.s", "integer", 3): 3, ("$.f", "integer", None): None, ("$.i", "number", 0.0): 5.0, ("$.f", "number", 0.0): 1.5, ("$.s", "string", ""): "5",
        ("$.i", "string", "d"): "d", ("$.n", "string", "d"): "d", ("$.x.y", "string", "d"): "d", ("$.t", "boolean", False): True, ("$.s", "boolean", False): False, ("$.a", "string", "d"): "d",
    }
    row = spark.createDataFrame([(json.dumps(DOC),)], "t string").select(*[m.value(doc, *k).alias(str(i)) for i, k in enumerate(asked)]).first()
    assert list(row) == list(asked.values())
    lists = spark.createDataFrame([(json.dumps(DOC),)], "t string").select(m.texts(doc, "$.a"), m.texts(doc, "$.s"), m.texts(doc, "$.x")).first()
    assert tuple(lists) == (["1", "x", "[2]"], None, None)


def test_texts_that_are_no_json(spark):
    rows = spark.createDataFrame([(None,), ("",), ("{",), ("[1]",), ("3",), ('"x"',)], "t string")
    found = rows.select(m.value(m.document(F.col("t")), "$.i", "integer", 9), m.group(F.col("t")), m.summary(F.col("t")).alias("s")).collect()
    assert [r[0] for r in found] == [9] * 6 and [r[1] for r in found] == [None] * 6
    assert all(r["s"]["train_rows"] is None and r["s"]["args"] == {} for r in found)


def test_groups_and_gate(spark):
    good = {"train_rows": 10, "prompt_versions_filter": ["v1"], "train_prompt_version_filter": {"allowed": ["v1"]}, "args": {"think": "<t>", "lr": 0.1, "require_thinking": True, "filter_correct_only": "yes"}}
    cases = [
        (good, "v1", []),
        ({**good, "train_rows": "10"}, "v1", ["missing train_rows"]),
        ({**good, "train_rows": 11}, "v1", ["train_rows=11, expected=10"]),
        ({**good, "prompt_versions_filter": None, "args": {**good["args"], "prompt_versions": " v2 ,"}}, "v2", ["prompt_versions=null", "allowed=[v1]"]),
        ({**good, "prompt_versions_filter": ["v1", " "], "args": {**good["args"], "require_thinking": False}}, "v1", ["prompt_versions=[v1, ]", "require_thinking is false"]),
        ({"args": [1]}, None, None),
    ]
    rows = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "i int, t string")
    named = rows.select("i", m.group(F.col("t")).alias("group"), m.summary(F.col("t")).alias("s")).select("i", "group", "s.*")
    for r in named.withColumn("errors", validation.metadata_errors(10, {"think": "<t>"})).collect():
        _, group, errors = cases[r["i"]]
        assert r["group"] == group
        if errors is not None:
            assert r["errors"] == errors, r
