import binascii
import hashlib
import html
import math
import re
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from qaflow.llm import media
from tests.llm.cases import documents, rows

PAGE = """<html><head><style>p{}</style><script>var t="</p><img src=x>";</script></head><body><h1>Title &amp; more</h1>
<p>One <b>two</b></p><figure><img src="sha256:{d}" alt="alt"><figcaption>The <i>caption</i></figcaption></figure>
three<br>four<img src="http://x/y.png" alt="plain"><figure><figcaption>first</figcaption><video src="sha256:{e}"></video></figure><p>tail"""


@given(st.binary(max_size=400))
def test_lossless(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload[: len(raw)] == raw and not any(payload[len(raw) :])
    assert media.from_png(media.to_png(payload, len(raw))) == (payload, len(raw))


def test_damage_is_noticed():
    data = bytearray(media.to_png(media.padded(b"x" * 300), 300))
    data[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(data))


def test_sequence_order_captions_and_positions():
    d, e = "a" * 64, "b" * 64
    items = media.parse(PAGE.replace("{d}", d).replace("{e}", e))
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [
        (0, "text", "Title & more", None, None),
        (1, "text", "One two", None, None),
        (2, "media", None, d, "The caption"),
        (3, "text", "three", None, None),
        (4, "text", "four", None, None),
        (5, "media", None, None, "plain"),
        (6, "media", None, e, None),
        (7, "text", "tail", None, None),
    ]
    assert media.parse(None) == media.parse("") == []


def test_resolution_keeps_positions(spark):
    d = "a" * 64
    pages = spark.createDataFrame([(1, PAGE.replace("{d}", d).replace("{e}", "b" * 64)), (2, f'<img src="sha256:{d}">'), (3, None)], "page_id long, html string")
    store = spark.createDataFrame([(d, "found")], "digest string, note string")
    out = media.resolve(media.sequences(pages), store).collect()
    assert sorted((r["page_id"], r["position"]) for r in out) == [(1, i) for i in range(8)] + [(2, 0)]
    assert {(r["page_id"], r["position"]) for r in out if r["note"]} == {(1, 2), (2, 0)}


def decoded(png):
    """Samples of an 8-bit greyscale PNG by the standard alone: chunks, zlib stream, and all five line filters."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, stream, width, height = 8, b"", 0, 0
    while at < len(png):
        size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        assert int.from_bytes(png[at + 8 + size : at + 12 + size], "big") == binascii.crc32(png[at + 4 : at + 8 + size])
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        elif kind == b"IDAT":
            stream += body
        at += 12 + size
    lines, before = [], [0] * width
    flat = zlib.decompressobj().decompress(stream)
    assert len(flat) == height * (width + 1)
    for y in range(height):
        kind, line = flat[y * (width + 1)], []
        for x, v in enumerate(flat[y * (width + 1) + 1 : (y + 1) * (width + 1)]):
            left, up, corner = (line[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
            p = left + up - corner
            nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line.append((v + (0, left, up, (left + up) // 2, nearest)[kind]) % 256)
        lines.append(bytes(line))
        before = line
    return b"".join(lines)


def described(payload):
    """The feature string by plain arithmetic."""
    n = len(payload)
    mean = sum(payload) / n
    deviation = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
    step = sum(abs(a - b) for a, b in zip(payload, payload[1:])) / (n - 1)
    bins = [0] * 16
    for x in payload:
        bins[x // 16] += 1
    return f"h={n // 64};mean={round(mean * 1000)};sd={round(deviation * 1000)};zero={payload.count(0)};step={round(step * 1000)};hist={'.'.join(map(str, bins))}"


def check_page(raw, r):
    """The row's references against a reading of its page by regular expressions: tags in order, texts between tags, digests that are stored."""
    page = media.page_of(r["doc_id"], raw)
    stored = {media.digest_of(x) for x in (raw, *[c.encode() for c in media.COVERS])}
    items = []
    for text, tag in re.findall(r"([^<>]+)|<([^>]*)>", re.sub(r"</?b>", "", page)):
        if tag.startswith(("img", "video")):
            src, alt = re.search('src="([^"]*)"', tag)[1], re.search('alt="([^"]*)"', tag)
            digest = src.removeprefix("sha256:") if src.startswith("sha256:") else None
            items.append([digest, alt[1] if alt else "", "external" if digest is None else "resolved" if digest in stored else "unresolved"])
        elif tag == "figcaption":
            items.append("caption")
        elif text and items and items[-1] == "caption":
            items.pop()
            items[-1][1] = html.unescape(text)
        elif text:
            items.append(text)
    references = [(i, x) for i, x in enumerate(items) if not isinstance(x, str)]
    assert r["n_items"] == len(items) >= 7
    assert r["references"] == ",".join(f"{i}:{x[1]}:{x[2]}" for i, x in references)
    assert (r["position"], r["caption"]) == next((i, x[1]) for i, x in references if x[0] == media.digest_of(raw))


def check_digests(spark, docs, texts, n_rows):
    stored = {r["digest"]: bytes(r["media"]) for r in media.store_texts(docs).collect()}
    by_hash = {hashlib.sha256(m).hexdigest(): m for m in stored.values()}
    out = media.digest_texts(docs).collect()
    assert len(out) == n_rows
    for r in out:
        if r["doc_id"] is None:
            continue
        raw = texts[r["doc_id"]]
        payload = raw + bytes((-len(raw)) % 64 or (64 if not raw else 0))
        png = by_hash[r["media_sha256"]]
        assert decoded(png) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"]) == (binascii.crc32(payload[-64:]), len(png))
        assert r["feature"] == described(payload)
        check_page(raw, r)


def test_digests(spark):
    texts = {r[0]: (r[1] or "").encode() for r in rows() if r[0] is not None}
    check_digests(spark, documents(spark), texts, len(rows()))


PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_digests_of_pages(spark):
    pages = spark.read.parquet(PAGES).selectExpr("page_id AS doc_id", "html AS text").limit(12)
    texts = {r["doc_id"]: r["text"].encode() for r in pages.collect()}
    check_digests(spark, pages, texts, len(texts))


def plain_words(page):
    """Words in document order by regular expressions: no comments, scripts and styles; inline tags join, others part."""
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style)>.*?</\1>", " ", page)
    page = re.sub(r"</?(?:a|b|i|em|span|title|head|meta|html)(?:\s[^>]*)?>", "", page)
    return html.unescape(re.sub(r"<[^>]*>", " ", page)).split()


def test_sequences_of_pages(spark):
    """Real pages, with two media references put in: texts keep their order, references their places and captions."""
    d, e = "a" * 64, "b" * 64
    figure = f'<figure><img src="sha256:{d}" alt="x"><figcaption>The caption</figcaption></figure>'
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(PAGES).collect()}
    marked = {k: h.replace("</h1>", "</h1>" + figure, 1).replace("<footer", f'<img src="sha256:{e}"><footer', 1) for k, h in pages.items()}
    df = spark.createDataFrame(list(marked.items()), "page_id long, html string")
    store = spark.createDataFrame([(d, "found")], "digest string, note string")
    out = media.resolve(media.sequences(df), store).orderBy("page_id", "position").collect()
    for k, h in pages.items():
        items = [r for r in out if r["page_id"] == k]
        assert [r["position"] for r in items] == list(range(len(items)))
        assert " ".join(r["text"] for r in items if r["kind"] == "text").split() == plain_words(h)
        assert [(r["digest"], r["caption"], r["note"]) for r in items if r["kind"] == "media"] == [(d, "The caption", "found"), (e, None, None)]
        head = next(i for i, r in enumerate(items) if r["kind"] == "media")
        before = " ".join(r["text"] for r in items[:head]).split()
        assert before == plain_words(h[: h.index("</h1>")])


def test_pages_vary(spark):
    texts = [(i, f"text {i // 2}") for i in range(300)]
    found = media.digest_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    for r in found:
        check_page(texts[r["doc_id"]][1].encode(), r)
    assert len(found) == 300 and len({r["position"] for r in found}) >= 5
    said = [x.rsplit(":", 1)[1] for r in found for x in r["references"].split(",")]
    assert all(said.count(k) > 10 for k in ("resolved", "unresolved", "external"))


def test_a_text_that_is_a_cover(spark):
    (r,) = media.digest_texts(spark.createDataFrame([(1, media.COVERS[2])], "doc_id long, text string")).collect()
    assert r["payload_sha256"] == hashlib.sha256(media.padded(media.COVERS[2].encode())).hexdigest()
    check_page(media.COVERS[2].encode(), r)
