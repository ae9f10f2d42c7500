"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit takes the latest earlier full response of its canonical URL. Records are first dealt into
ranges of (time, record id) of about equal size, so the as-of join has two parts: within a range by a
window over (URL, range), and across ranges by the last response of each earlier range, of which a URL
has at most one. No URL, however often captured, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaflow.llm.common import materialize

#: Headers that a 304 response may update (RFC 9110, section 15.4.5, and RFC 9111, section 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

_DROPPED = "^(utm_[a-z_]*|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host without scheme, default port, "www." or case; path without a final slash; query sorted, without tracking keys or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(_DROPPED)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with the permitted ones of the revisit in place of their namesakes, sorted by name."""
    allowed = F.filter(update, lambda x: F.lower(x["name"]).isin(*PERMITTED))
    kept = F.filter(stored, lambda x: ~F.exists(allowed, lambda y: F.lower(y["name"]) == F.lower(x["name"])))
    return F.sort_array(F.concat(kept, allowed))


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per revisit: record_id, url_key, ts, response_id, status, payload_digest, headers.

    ``records`` has record_id, url, ts (both orderable numbers or times), kind ('response' or 'revisit'),
    payload_digest, etag, last_modified and headers (array<struct<name, value>>). Status is

    - ``no_response``: no earlier response of the URL, or no URL; the other columns are null;
    - ``unverified``: the revisit has no validator; the response's payload is taken;
    - ``resolved``: its etag (weak comparison), or without one its last_modified, equals the response's;
    - ``mismatch``: it does not; response_id tells which was tried, payload and headers are null.

    Earlier means a smaller (ts, record_id), so a revisit never sees a response with its own; a null ts sorts first. Of
    responses with equal (ts, record_id) the one with the greatest etag, last_modified, payload_digest and headers counts.
    Repeated rows each get a row; null headers count as none. Other columns are ignored; empty tables give an empty result.
    """
    n = ranges or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = F.when(
        (F.col("kind") == "response") & F.col("url_key").isNotNull(),
        F.struct("ts", "record_id", "etag", "last_modified", "payload_digest", "headers"),
    )
    keyed = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "payload_digest", "etag", "last_modified",
        F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")).alias("headers"),
    ).where("kind IN ('response', 'revisit')")
    dealt = keyed.repartitionByRange(n, "ts", "record_id").withColumn("range", F.spark_partition_id()).withColumn("full", full)
    dealt = materialize(dealt, "records")
    known = dealt.where("url_key IS NOT NULL")
    # the last response of each (URL, range), carried on to the URL's later ranges
    ends = known.groupBy("url_key", "range").agg(F.max("full").alias("end"))
    over = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url_key", "range", F.last("end", ignorenulls=True).over(over).alias("carried"))
    # among equals revisits come first, so that none sees a response of its own (ts, record_id)
    order = ["ts", "record_id", F.col("kind") == "response", "etag", "last_modified", "payload_digest", "headers"]
    inside = Window.partitionBy("url_key", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    joined = near.join(carried.where("carried IS NOT NULL"), ["url_key", "range"], "left").withColumn("found", F.coalesce("near", "carried"))
    lost = dealt.where("url_key IS NULL AND kind = 'revisit'")
    rows = joined.unionByName(lost, allowMissingColumns=True)
    same_tag = _strong(F.col("etag")) == _strong(F.col("found.etag"))
    same_date = F.col("last_modified") == F.col("found.last_modified")
    status = (
        F.when(F.col("found").isNull(), "no_response")
        .when(F.col("etag").isNull() & F.col("last_modified").isNull(), "unverified")
        .when(F.coalesce(F.when(F.col("etag").isNotNull(), same_tag).otherwise(same_date), F.lit(False)), "resolved")
        .otherwise("mismatch")
    )
    good = F.col("status").isin("resolved", "unverified")
    return rows.withColumn("status", status).select(
        "record_id",
        "url_key",
        "ts",
        F.col("found.record_id").alias("response_id"),
        "status",
        F.when(good, F.col("found.payload_digest")).alias("payload_digest"),
        F.when(good, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history for the ``pages`` table, page p at time p.

    Each page has a full response; every fourth a second one with other content 400 steps later; and every seventh page is
    a capture of one front page, whose content changes every 70 steps, so that a URL holds many captures. Revisits: one of
    each page, 1 to 1,000 steps later, with a weak etag, a date alone, or both validators; of some pages one without validators, one
    before the page's own capture, one with the same time and record_id as the response, and one without a URL; and many of the front page.
    Null html counts as empty.
    """
    p = F.col("page_id")
    html = F.coalesce("html", F.lit(""))
    tag = lambda c: F.concat(F.lit('"'), F.md5(c.cast("binary")), F.lit('"'))
    day = lambda c: F.concat(F.lit("day "), F.length(c).cast("string"))
    header = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    none = F.lit(None).cast("string")

    def response(when, number, url, at, body):
        headers = F.array(header("Content-Type", F.lit("text/html")), header("ETag", tag(body)), header("Date", at.cast("string")))
        return _record(when, p * 8 + number, url, at, "response", tag(body), day(body), F.sha2(body.cast("binary"), 256), headers)

    def revisit(when, number, url, at, etag, modified):
        headers = F.array(header("date", at.cast("string")), header("Set-Cookie", F.lit("s=1")), header("Cache-Control", F.lit("max-age=60")))
        return _record(when, p * 8 + number, url, at, "revisit", etag, modified, none, headers)

    url, always = F.col("url"), F.lit(True)
    front = F.concat(F.lit("front "), F.floor(p / 70).cast("string"))
    later = p + 1 + F.pmod(p * 7919, F.lit(1000))
    own = F.when(p % 3 == 0, none).when(p % 5 == 0, F.concat(F.lit("W/"), tag(html))).otherwise(tag(html))
    records = [
        response(always, 0, url, p, html),
        response(p % 4 == 2, 1, url, p + 400, F.concat(html, F.lit("changed"))),
        response(p % 7 == 0, 2, F.lit("https://WWW.front.example.org:443/?utm_source=x#top"), p, front),
        revisit(always, 3, url, later, own, day(html)),
        revisit(p % 5 == 1, 4, url, p + 500, none, none),
        revisit(p % 6 == 0, 5, url, p - 3, tag(html), none),
        revisit(p % 9 == 0, 0, url, p, tag(html), none),
        revisit(p % 7 == 3, 6, F.lit("http://front.example.org"), p, tag(front), none),
        revisit(p % 50 == 0, 7, none, p, tag(html), none),
    ]
    return pages.select(F.explode(F.array_compact(F.array(*records))).alias("r")).select("r.*")


def _record(when: Column, record_id: Column, url: Column, ts: Column, kind: str, etag: Column, modified: Column, digest: Column, headers: Column) -> Column:
    fields = {"record_id": record_id, "url": url, "ts": ts, "kind": F.lit(kind), "etag": etag, "last_modified": modified, "payload_digest": digest, "headers": headers}
    return F.when(when, F.struct(*[c.alias(k) for k, c in fields.items()]))
