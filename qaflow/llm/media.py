"""Media columns: interleaved document sequences with payloads resolved by digest.

HTML is parsed into an ordered sequence of text and media-reference structs; a reference carries the
digest of its payload and its caption, and keeps its position. A media table holds each payload as an
8-bit greyscale PNG beside the digest of the payload. Joining the sequences with the table on the digest
resolves the references; text rows and unresolved references stay in place.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaflow.llm.common import materialize

UNIT = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes | None) -> bytes:
    """The bytes with zeros appended up to a positive multiple of UNIT."""
    text = text or b""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int, level: int = 6) -> bytes:
    """A greyscale PNG of width UNIT whose samples are the payload; a text chunk keeps the unpadded length."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # each line begins with its filter type, here none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    note = b"Length\0" + str(n_bytes).encode()
    return b"".join([_SIGNATURE, _chunk(b"IHDR", head), _chunk(b"tEXt", note), _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)), _chunk(b"IEND", b"")])


def from_png(data: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length of a PNG that ``to_png`` made; checks every chunk's checksum."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, idat, height, n_bytes = 8, [], 0, 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour) != (UNIT, 8, 0):
                raise ValueError("other sample format")
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            n_bytes = int(body[7:])
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(height, UNIT + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes(), n_bytes


def features(payload: bytes) -> str:
    """Height, mean, deviation, share of zero samples, mean step between neighbours, and a 16-bin histogram, in integers."""
    x = np.frombuffer(payload, np.uint8)
    mean, var = x.mean(dtype=np.float64), x.var(dtype=np.float64)
    step = np.abs(np.diff(x.astype(np.int16))).mean(dtype=np.float64)
    bins = ".".join(map(str, np.bincount(x >> 4, minlength=16).tolist()))
    return f"h={len(x) // UNIT};mean={round(mean * 1000)};sd={round(var**0.5 * 1000)};zero={int((x == 0).sum())};step={round(step * 1000)};hist={bins}"


class _Sequence(HTMLParser):
    """Collects (kind, text, source, caption) in document order."""

    _BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
    _MEDIA = frozenset(["img", "audio", "video", "source", "embed"])
    _HIDDEN = frozenset(["script", "style", "template", "noscript"])

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []  # for each open figure, the number of items at its start
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.items.append(["text", text, None, None])
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in self._HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag == "figure":
            self.flush()
            self.figures.append(len(self.items))
        elif tag in self._MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self.flush()
                self.items.append(["media", None, given["src"], given.get("alt") or None])
        elif tag in self._BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self._HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                if item[0] == "media" and text:
                    item[3] = text
            self.caption = None
        elif tag == "figure" and self.figures:
            self.flush()
            self.figures.pop()
        elif tag in self._BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.words.append(data)


_DIGEST = re.compile(r"sha256:([0-9a-f]{64})")


def parse(html: str | None) -> list[dict]:
    """Ordered structs of a page: position, kind, text, src, digest (of ``sha256:`` sources), caption."""
    if not html:
        return []
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser.flush()
    found = []
    for position, (kind, text, src, caption) in enumerate(parser.items):
        m = _DIGEST.fullmatch(src) if src else None
        found.append({"position": position, "kind": kind, "text": text, "src": src, "digest": m and m[1], "caption": caption})
    return found


_ITEM = "struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>"


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html", kept: tuple[str, ...] = ()) -> DataFrame:
    """(key, items, and the ``kept`` columns): one row per page, ``items`` the ordered structs; null or empty HTML gives an empty array.

    Repeated rows and keys give a row each; a null key stays null; other columns are ignored; an empty table gives an
    empty result. A page is parsed as a whole, however long.
    """
    keyed = pages.select(F.col(key).cast("long").alias(key), F.col(html).alias("__html"), *kept)

    def run(batches):
        kind = pa.list_(pa.struct([("position", pa.int32()), *[(k, pa.string()) for k in ("kind", "text", "src", "digest", "caption")]]))
        for batch in batches:
            items = pa.array([parse(h) for h in batch.column(1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), items, *batch.columns[2:]], [key, "items", *kept])

    made = T.StructType.fromDDL(f"`{key}` long, items array<{_ITEM}>")
    return keyed.mapInArrow(run, T.StructType([*made.fields, *[keyed.schema[c] for c in kept]]))


def resolve(seqs: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per item with its ``position`` in the page, and the columns of ``media`` for its digest (null for text and unknown digests).

    Further columns of ``seqs`` are repeated on each item.

    ``media`` has one row per ``digest``; its other columns may not be named like an item's. Items without a digest get a
    key of their own, so they cannot pile up under a null; a digest that very many pages share is left to adaptive
    execution to split. Pages without items give no rows; rows of repeated pages stay; empty tables give an empty result.
    """
    kept = [c for c in seqs.columns if c not in (key, "items")]
    items = seqs.select(key, *kept, F.explode("items").alias("item")).select(key, *kept, "item.*")
    spread = F.concat(F.lit("none:"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.col("position").cast("string"))
    keyed = items.withColumn("join_digest", F.coalesce("digest", spread))
    return keyed.join(media.withColumnRenamed("digest", "join_digest"), "join_digest", "left").drop("join_digest")


#: Texts of the media that pages share.
COVERS = tuple(f"cover {i}" for i in range(5))


def digest_of(raw: bytes) -> str:
    """Digest of a payload and its unpadded length."""
    return hashlib.sha256(padded(raw) + len(raw).to_bytes(8, "big")).hexdigest()


def page_of(doc: int | None, raw: bytes) -> str:
    """A page about a text: blocks of text between references to its own payload, to a cover shared with many pages, and at times to media that are lost or elsewhere.

    What stands where follows from the text's checksum, so references have various positions and equal texts equal ones.
    """
    check = zlib.crc32(raw)
    cover = COVERS[check % len(COVERS)]
    parts = [
        f"<p>Checksum <b>{check:08x}</b> &amp; more</p>",
        f'<img src="sha256:{digest_of(cover.encode())}" alt="{cover}">',
        f"<ul><li>{raw.count(10) + 1} lines</li><li>{len(raw)} bytes</li></ul>",
        f'<figure><img src="sha256:{digest_of(raw)}" alt="text"><figcaption>Text of {len(raw)} bytes</figcaption></figure>',
        "<p>End of the text.</p>",
    ]
    if check % 7 == 0:
        parts.append(f'<img src="sha256:{hashlib.sha256(b"lost" + raw).hexdigest()}" alt="lost">')
    if check % 11 == 0:
        parts.append(f'<video src="https://media.example.org/{check:08x}.mp4"></video>')
    turn = check // 77 % len(parts)
    return f'<article><h1>Document {"" if doc is None else doc}</h1>{"".join(parts[turn:] + parts[:turn])}</article>'


def store_texts(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, html, digest, media): each text as a PNG, and a page that refers to it by the digest of its payload; ``rid`` numbers the rows."""

    def made(rids, ids, html, digests, media):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((rids, ids, html, digests, media), kinds)], ["rid", "doc_id", "html", "digest", "media"])

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_py() or b""
                for column, value in zip(out, (rid, doc, page_of(doc, raw), digest_of(raw), to_png(padded(raw), len(raw)))):
                    column.append(value)
                size += len(out[4][-1])
                if size > 2 << 20:  # the output's batches stay small however long the texts
                    yield made(*out)
                    out, size = ([], [], [], [], []), 0
            if out[0]:
                yield made(*out)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "rid long, doc_id long, html string, digest string, media binary")


_PROBE = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def probe(stored: DataFrame) -> DataFrame:
    """Read stored media back: one row per digest with sizes, digests, checksum of the tail and features."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in _PROBE]
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = media.as_py()
                payload, n = from_png(data)
                values = (digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(payload))
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64() if k in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes") else pa.string() for k in _PROBE]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], _PROBE)

    rows = stored.select("digest", "media").mapInArrow(
        run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return rows.groupBy("digest").agg(*[F.min(c).alias(c) for c in _PROBE[1:]])


def digest_texts(docs: DataFrame) -> DataFrame:
    """Store every text as media, parse the pages that refer to them, and resolve the references by digest.

    One row per input row: doc_id, the probe's columns of its own payload, the own reference's ``position`` and
    ``caption`` (of several, as where a text is a cover's, the first), ``n_items`` of the page, and ``references``, all of the page in order as position:caption:status with
    the status resolved, unresolved (a digest that is not stored) or external (no digest). Null text counts as empty (a payload
    of one zero unit); equal texts have equal values; repeated rows stay; very long texts are one payload; columns besides doc_id
    and text are ignored; an empty table gives an empty result. The media table is written once to the shared folder and
    read back from there.
    """
    stored = materialize(store_texts(docs), "media")
    covers = store_texts(docs.sparkSession.createDataFrame([(None, c) for c in COVERS], "doc_id long, text string"))
    every = stored.select("digest", "media").unionByName(covers.select("digest", "media"))
    probed = materialize(probe(every), "probes")  # a table of its own, so that adaptive execution can split a hot digest's join
    pages = stored.select("rid", "html", "doc_id", F.col("digest").alias("own"))
    parsed = sequences(pages, "rid", kept=("doc_id", "own"))
    # text blocks keep their places in the positions; only references go to the join
    own_at = F.array_position(F.transform("items", lambda x: F.coalesce(x["digest"], F.lit(""))), F.col("own")) - 1
    references = F.filter("items", lambda x: x["kind"] == "media")
    found = resolve(parsed.select("rid", "doc_id", F.size("items").cast("long").alias("n_items"), own_at.alias("own_at"), references.alias("items")), probed, "rid")
    status = F.when(F.col("digest").isNull(), "external").when(F.col("media_bytes").isNull(), "unresolved").otherwise("resolved")
    reference = F.concat_ws(":", F.col("position").cast("string"), F.coalesce("caption", F.lit("")), status)
    # only the own reference carries its payload's columns into the next exchange
    mine = F.when(F.col("position") == F.col("own_at"), F.struct(*_PROBE[1:], "position", "caption"))
    slim = found.select("rid", "doc_id", "n_items", F.struct("position", reference.alias("said")).alias("reference"), mine.alias("mine"))
    rows = slim.groupBy("rid", "doc_id", "n_items").agg(F.sort_array(F.collect_list("reference")).alias("references"), F.first("mine", True).alias("mine"))
    return rows.select("doc_id", "mine.*", "n_items", F.array_join(F.transform("references", lambda x: x["said"]), ",").alias("references"))
