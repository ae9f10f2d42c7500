import random

import pytest
from pyspark.sql import functions as F

from qaflow.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, payload_digest string, etag string, last_modified string, headers array<struct<name:string,value:string>>, extra int"


def records(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = "http://hot.example.org/" if rng.random() < 0.4 else f"https://www.site{rng.randrange(12)}.example.org/p/?utm_source=x"
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        tag = rng.choice([None, '"a"', '"b"', 'W/"a"'])
        day = rng.choice([None, "d1", "d2"])
        rows.append((i, rng.choice([url, url, None]), rng.choice([None, *range(60)]), kind, f"sha{i}" if kind == "response" else None, tag, day, [("ETag", str(tag)), ("X", str(i))], 1))
    return rows


def brute(rows, keys):
    out = {}
    order = lambda r: (r[2] is not None, r[2] or 0, r[0])
    for r in rows:
        if r[3] != "revisit":
            continue
        key = keys[r[1]]
        earlier = [x for x in rows if x[3] == "response" and key is not None and keys[x[1]] == key and order(x) < order(r)]
        if not earlier:
            out[r[0]] = ("no_response", None, None)
            continue
        best = max(earlier, key=order)
        strong = lambda t: t[2:] if t and t.startswith("W/") else t
        if r[5] is None and r[6] is None:
            status = "unverified"
        elif r[5] is not None:
            status = "resolved" if best[5] is not None and strong(r[5]) == strong(best[5]) else "mismatch"
        else:
            status = "resolved" if best[6] == r[6] else "mismatch"
        out[r[0]] = (status, best[0], best[4] if status in ("resolved", "unverified") else None)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_equals_brute_force(spark, ranges):
    rows = records()
    df = spark.createDataFrame(rows, SCHEMA)
    keys = {r["url"]: r["k"] for r in df.select("url", warc.canonical_url(F.col("url")).alias("k")).distinct().collect()}
    found = {r["record_id"]: (r["status"], r["response_id"], r["payload_digest"]) for r in warc.resolve_revisits(df, ranges).collect()}
    assert found == brute(rows, keys)


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.org:80/A/b/#top": "example.org/A/b",
        "https://example.org/A/b?b=2&utm_source=x&a=1": "example.org/A/b?a=1&b=2",
        "https://example.org:443?ref=x": "example.org",
        "http://m.example.org/x.html": "m.example.org/x.html",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["k"] for r in df.withColumn("k", warc.canonical_url(F.col("u"))).collect()} == cases


def test_only_permitted_headers_are_merged(spark):
    rows = [
        (1, "http://a/", 1, "response", "sha", '"t"', None, [("Content-Type", "text"), ("Date", "old"), ("Set-Cookie", "keep")], 1),
        (2, "http://a/", 2, "revisit", None, '"t"', None, [("date", "new"), ("Set-Cookie", "drop"), ("Content-Length", "0"), ("ETag", '"t"')], 1),
    ]
    out = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).first()
    assert {(h["name"], h["value"]) for h in out["headers"]} == {("Content-Type", "text"), ("Set-Cookie", "keep"), ("date", "new"), ("ETag", '"t"')}


@pytest.mark.parametrize("flip", [False, True])
def test_equal_keys(spark, flip):
    """A revisit doesn't see a response of its own (ts, record_id), whatever the order of the rows; of equal responses the greatest counts."""
    rows = [
        (1, "http://a/", 1, "response", "old", '"a"', None, [], 1), (5, "http://a/", 9, "response", "own", '"b"', None, [], 1), (5, "http://a/", 9, "revisit", None, '"a"', None, None, 1),
        (5, "http://a/", 9, "response", "own2", '"c"', None, [], 1), (6, "http://a/", 9, "revisit", None, '"c"', None, [], 1), (5, "http://b/", 9, "response", "x", '"a"', None, [], 1),
        (5, "http://b/", 9, "revisit", None, '"a"', None, [], 1), (5, "http://b/", 9, "revisit", None, '"a"', None, [], 1),
    ]
    df = spark.createDataFrame(rows[::-1] if flip else rows, SCHEMA).coalesce(1)
    found = sorted((r["url_key"], r["record_id"], r["status"], r["payload_digest"]) for r in warc.resolve_revisits(df, 3).collect())
    assert found == [("a", 5, "resolved", "old"), ("a", 6, "resolved", "own2"), ("b", 5, "no_response", None), ("b", 5, "no_response", None)]


@pytest.mark.parametrize("flip", [False, True])
@pytest.mark.parametrize("ranges", [1, 3])
def test_responses_that_differ_in_headers_alone(spark, flip, ranges):
    """The one with the greatest headers counts, within a range of rows and over several."""
    same = lambda v: (1, "http://a/", 1, "response", "p", '"a"', None, [("Server", v)], 1)
    rows = [same("a"), same("c"), same("b"), (2, "http://a/", 2, "revisit", None, '"a"', None, [], 1)]
    df = spark.createDataFrame(rows[::-1] if flip else rows, SCHEMA).coalesce(1)
    (found,) = warc.resolve_revisits(df, ranges).collect()
    assert [(h["name"], h["value"]) for h in found["headers"]] == [("Server", "c")]


def test_clashing_columns(spark):
    rows = [(1, "http://a/", 1, "response", "s", '"t"', None, [], 7, 8, "n"), (2, "http://a/", 2, "revisit", None, '"t"', None, [], 7, 8, "n")]
    df = spark.createDataFrame(rows, SCHEMA.replace("extra int", "full int, range int, near string"))
    assert [(r["record_id"], r["response_id"]) for r in warc.resolve_revisits(df).collect()] == [(2, 1)]


def test_history_of_pages_has_every_status(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    history = warc.records_of_pages(pages)
    assert {r["status"] for r in warc.resolve_revisits(history).select("status").distinct().collect()} == {"no_response", "unverified", "resolved", "mismatch"}
    rows = [tuple(r[c] for c in ("record_id", "url", "ts", "kind", "payload_digest", "etag", "last_modified", "headers")) for r in history.collect()]
    keys = {r["url"]: r["k"] for r in history.select("url", warc.canonical_url(F.col("url")).alias("k")).distinct().collect()}
    tied = {r[0] for r in rows if r[0] % 8 == 0 and r[3] == "revisit"}
    found = {r["record_id"]: (r["status"], r["response_id"], r["payload_digest"]) for r in warc.resolve_revisits(history, 5).collect()}
    assert tied and found == brute(rows, keys)


def test_empty_and_null(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/", None), (2, "http://a/", None)], "page_id long, url string, html string")
    out = warc.resolve_revisits(warc.records_of_pages(pages)).collect()
    assert {r["status"] for r in out if r["url_key"] is None} == {"no_response"} and len(out) == 3 + 1
