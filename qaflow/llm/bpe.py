"""Byte-level BPE with a hierarchical-bitmap rank queue, and decoding.

Each pre-token is merged on a linked list of byte positions. For every merge rank there is a bucket of
positions; three levels of bitmaps say which buckets are filled, so find-first-set gives the least rank
in constant time. A merge pushes the two new pairs; entries that a merge made stale are skipped when
popped. A pre-token of n bytes takes O(n log n) steps whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaflow.llm.common import text_blocks


class Encoder:
    """Encoder and decoder for one rank file.

    ``cache_size`` bounds the pre-tokens whose ids are kept, in two generations: a full young one
    replaces the old one, so frequent pre-tokens stay.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 800_000) -> None:
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.pieces = [b""] * self.size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.names = [str(i) for i in range(self.size)]
        self.split = regex.compile(pattern).findall
        self.twos = [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
        # the rank queue's bitmaps: which ranks of a word of 64, and which words of a group of 64, have filled buckets
        self.low = [0] * (self.size // 64 + 1)
        self.mid = [0] * (self.size // 4096 + 1)
        self.half = max(1, cache_size // 2)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str, cache_size: int = 800_000) -> Encoder:
        """Read lines of a base64 piece and its rank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        return cls(ranks, pattern, cache_size)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token. The queue's push and pop are written out in line, as this is the hot loop."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return (whole,)
        n, low, mid, top = len(piece), self.low, self.mid, 0
        buckets: dict[int, list[int]] = {}  # the filled buckets: a heap of positions for each rank
        at = buckets.get
        end = list(range(1, n + 1))  # a live position begins the symbol piece[position:end[position]]
        before = list(range(-1, n - 1))
        twos = self.twos
        pair = [twos[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of the symbol at a position with the next one
        pair.append(None)
        for i, r in enumerate(pair):
            if r is not None:
                if bucket := at(r):
                    bucket.append(i)  # ascending positions are a heap
                else:
                    buckets[r] = [i]
                    low[r >> 6] |= 1 << (r & 63)
                    mid[r >> 12] |= 1 << (r >> 6 & 63)
                    top |= 1 << (r >> 12)
        while top:
            # find-first-set down the three levels gives the least rank, its heap the leftmost position
            v = (top & -top).bit_length() - 1
            m = mid[v]
            w = (v << 6) + (m & -m).bit_length() - 1
            x = low[w]
            rank = (w << 6) + (x & -x).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[w] = x = x & (x - 1)
                if not x:
                    mid[v] = m = m & (m - 1)
                    if not m:
                        top &= top - 1
            if pair[i] != rank:
                continue  # stale: a merge has changed or taken this symbol since
            j = end[i]
            k = end[i] = end[j]
            pair[j] = pair[i] = None
            if k < n:
                before[k] = i
                pair[i] = r = get(piece[i : end[k]])
                if r is not None:
                    if bucket := at(r):
                        heappush(bucket, i)
                    else:
                        buckets[r] = [i]
                        low[r >> 6] |= 1 << (r & 63)
                        mid[r >> 12] |= 1 << (r >> 6 & 63)
                        top |= 1 << (r >> 12)
            h = before[i]
            if h >= 0:
                pair[h] = r = get(piece[h:k])
                if r is not None:
                    if bucket := at(r):
                        heappush(bucket, h)
                    else:
                        buckets[r] = [h]
                        low[r >> 6] |= 1 << (r & 63)
                        mid[r >> 12] |= 1 << (r >> 6 & 63)
                        top |= 1 << (r >> 12)
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _ids(self, token: str) -> tuple[int, ...]:
        found = self.young.get(token)
        if found is None:
            found = self.old.get(token)
            if found is None:
                found = self.merge(token.encode("utf-8"))
            if len(token) <= 64:
                if len(self.young) >= self.half:
                    self.old, self.young = self.young, {}
                self.young[token] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text; every match of the pattern is merged separately."""
        young, slow = self.young, self._ids
        out = []
        for token in self.split(text):
            ids = young.get(token)
            if ids is None:
                ids = slow(token)
                young = self.young
            out.append(ids)
        return list(chain.from_iterable(out))

    def rest(self) -> None:
        """Between tasks only the young generation is kept, so that a waiting worker holds little memory."""
        self.old = {}

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of ids."""
        return b"".join(map(self.pieces.__getitem__, ids))


_ENCODERS: dict[tuple[str, str, int], Encoder] = {}


def _encoder(*key) -> Encoder:
    """One encoder per worker process and setting."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder.from_file(*key)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", cache_size: int = 400_000) -> DataFrame:
    """Every row of ``docs`` with its ids as ``array<int>`` in a new last column ``ids``.

    Null and empty texts give an empty array; very long ones are encoded whole. Repeated rows stay. Other columns pass
    through unchanged; a column of the name ``ids`` is replaced. An empty table gives an empty result. ``path`` must exist on every executor, as the installed vocabularies do.
    """
    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        encoder = _encoder(path, pattern, cache_size)
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for a, b in text_blocks(batch.column(place)):
                part = batch.slice(a, b - a)
                encoded = [encoder.encode(t) if t else [] for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(encoded, pa.list_(pa.int32()))], [*kept, ids])
        encoder.rest()

    return docs.select(*kept).mapInArrow(run, schema)


def digest_documents(docs: DataFrame, path: str, pattern: str, cache_size: int = 800_000) -> DataFrame:
    """Encode, decode the ids again, and return one row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Digests are lowercase hex: of the decimal ids joined by commas, and of the decoded bytes. Null and
    empty texts have no tokens and the digests of nothing. Very long texts are encoded whole, in time that grows as n log n at
    most. Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        encoder = _encoder(path, pattern, cache_size)
        for batch in batches:
            for a, b in text_blocks(batch.column(1)):
                part = batch.slice(a, b - a)
                counts, ids_sha, text_sha = [], [], []
                for t in part.column(1).to_pylist():
                    ids = encoder.encode(t) if t else []
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(encoder.names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
