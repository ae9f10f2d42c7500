"""Substring deduplication by MinHash banding of paragraphs.

Paragraphs are of three kinds. Lines are the natural ones: a line of at least ``line`` words, or shorter lines in a
row that have as many together. Since a passage may stand anywhere within longer lines, there are also blocks of
exactly ``block`` words that begin at words picked by winnowing (the least shingle hash among ``winnow`` positions
in a row). The choice depends on nearby words only, so any passage of ``winnow + block - 1`` words (51 by default) has
a whole block that is cut alike wherever the passage stands. An edit within a block takes it far below the
threshold, so there are also runs of ``run`` words that begin at the same words and are still similar after one. A text
shorter than a block is one paragraph if it has a shingle.

Paragraphs of equal words share an id; blocks are compared by it alone. MinHash values of the five-word shingles of lines and
runs are banded; those of a kind that collide in a band are compared by exact Jaccard similarity of their shingle sets;
linked ones form components. In a component that spans documents the first occurrence stays and the others are removals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaflow.llm.common import Scratch, packed
from qaflow.llm.components import connected_components


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands of ``rows`` values with which a pair at the threshold collides with probability ``recall``."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


@dataclass(frozen=True)
class ParagraphConfig:
    """With the defaults, five bands of three values find a pair of paragraphs at 0.8 with probability 0.972, one at 0.9 with 0.9985.

    Blocks are short, so an edit within one takes it far below the threshold; they are there for passages
    that repeat word by word, and equal ones are always found. A run of 50 words has 46 shingles, so one edit leaves a similarity of 0.804. ``line`` may be as
    low as ``shingle``; then boilerplate lines of a few words are found as well. ``most`` different
    paragraphs with ``most_shingles`` shingles are compared in one task; larger buckets are compared block by block.
    """

    block: int = 20
    line: int = 20
    run: int = 50
    winnow: int = 32
    shingle: int = 5
    threshold: float = 0.8
    rows: int = 3
    recall: float = 0.97
    most: int = 1024
    most_shingles: int = 4 << 20

    @property
    def bands(self) -> int:
        return bands_for(self.threshold, self.rows, self.recall)


_LOW = (1 << 32) - 1
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2^64, kept between calls up to a million."""
    if len(_POWERS[0]) <= n:
        made = []
        for base in (_P, _P_INVERSE):
            p = np.full(max(n, 1 << 16) + 1, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if n > 1 << 20:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


_IS_SPACE = np.array([chr(i) in " \t\n\x0b\x0c\r" for i in range(256)])


_S30, _S27, _S31, _M1, _M2 = map(np.uint64, (30, 27, 31, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


#: Odd multipliers of the MinHash functions; shingle hashes are already mixed.
_ODD = _mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range of ``values`` that does not depend on where the range lies."""
    sums, down = _sums(values)
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _run_hash(values: np.ndarray, n: int) -> np.ndarray:
    """``_range_hash`` of every ``n`` values in a row."""
    sums, down = _sums(values)
    return _mix((sums[n:] - sums[:-n]) * down[: len(sums) - n] + np.uint64(n))


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


class Words:
    """A text's words as byte ranges, and their hashes."""

    def __init__(self, text: bytes) -> None:
        raw = np.frombuffer(text.lower(), np.uint8)
        edge = np.ones(len(raw) + 2, bool)
        np.take(_IS_SPACE, raw, out=edge[1:-1], mode="clip")  # nothing is to clip; without a mode numpy copies
        turns = np.flatnonzero(edge[1:] != edge[:-1])
        self.begin, self.end = turns[::2], turns[1::2]
        self.raw, self.ascii = raw, text.isascii()
        self.words = _range_hash(np.add(raw, np.uint64(1), dtype=np.uint64), self.begin, self.end)

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word in code points of the text."""
        if self.ascii:
            return self.begin, self.end
        points = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=points[1:])
        return points[self.begin], points[self.end]


class Cut(Words):
    """The words' shingles, and the text's paragraphs as word ranges [first, last)."""

    def __init__(self, text: bytes, config: ParagraphConfig) -> None:
        super().__init__(text)
        self.lines = self.blocks = 0
        n = len(self.words)
        self.first = self.last = np.zeros(0, np.int64)
        self.shingles = np.zeros(0, np.uint64)
        if n < config.shingle:
            return
        self.shingles = _run_hash(self.words, config.shingle)
        if n < config.block:
            self.lines, self.first, self.last = 1, np.zeros(1, np.int64), np.full(1, n, np.int64)
            return
        starts = self._anchors(self.shingles[: n - config.block + 1], config.winnow)
        first, last = self._natural(n, config.line)
        self.lines, self.blocks = len(first), len(starts)  # lines come first, then blocks, then runs
        runs = starts[starts + config.run <= n]
        self.first = np.concatenate([first, starts, runs])
        self.last = np.concatenate([last, starts + config.block, runs + config.run])

    def _natural(self, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges of the lines that have ``least`` words, and of shorter lines in a row that have them together."""
        turn = np.searchsorted(self.begin, np.flatnonzero(self.raw == 10))  # the word after each line's end
        turn = turn[(turn > 0) & (turn < n)]
        turn = turn[np.diff(turn, prepend=0) > 0]
        first, last = np.concatenate([[0], turn]), np.concatenate([turn, [n]])
        long = last - first >= least
        opens = np.ones(len(first), bool)
        opens[1:] = long[1:] | long[:-1]
        first, last = first[opens], np.append(first[opens][1:], n)
        whole = last - first >= least
        return first[whole], last[whole]

    @staticmethod
    def _anchors(keys: np.ndarray, winnow: int) -> np.ndarray:
        """Positions that hold the least key of some ``winnow`` positions in a row (of all, if there are fewer)."""
        if len(keys) <= winnow:
            return np.array([keys.argmin()])
        keys = np.ascontiguousarray(keys)
        views = np.ndarray((len(keys) - winnow + 1, winnow), keys.dtype, keys, 0, (keys.itemsize, keys.itemsize))
        at = views.argmin(1) + np.arange(len(views))  # never decreases
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        return at[new]

    def ids(self) -> np.ndarray:
        """One number per paragraph; equal words give equal numbers."""
        return _range_hash(self.words, self.first, self.last).view(np.int64) if len(self.first) else np.zeros(0, np.int64)

    def banded(self) -> np.ndarray:
        """Numbers of the lines and runs."""
        return np.concatenate([np.arange(self.lines), np.arange(self.lines + self.blocks, len(self.first))])

    def band_keys(self, config: ParagraphConfig, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the lines and runs (or those given), and for each band (row) and each of them (column) a key of its least hashed shingles and its kind."""
        number = self.banded() if number is None else number
        kind = self.is_run(number).astype(np.uint64)
        keys = np.arange(2, 2 * config.bands + 2, 2, dtype=np.uint64)[:, None] + kind
        if not len(number):
            return number, keys.view(np.int64)
        bounds = np.empty(2 * len(number), np.int64)
        bounds[::2], bounds[1::2] = self.first[number], self.last[number] - (config.shingle - 1)
        shingles = np.append(self.shingles, np.uint64(0))  # a bound may be the end
        at_once = max(1, (1 << 21) // (len(shingles) * config.rows))
        for i in range(0, config.bands, at_once):
            j = min(i + at_once, config.bands)
            values = shingles * _ODD[i * config.rows : j * config.rows, None]
            least = np.minimum.reduceat(values, bounds, axis=1)[:, ::2].reshape(j - i, config.rows, -1)
            for row in range(config.rows):
                keys[i:j] = _mix(keys[i:j] * np.uint64(0xC2B2AE3D27D4EB4F) + least[:, row])
        return number, keys.view(np.int64)

    def is_run(self, number: np.ndarray) -> np.ndarray:
        """Whether the lines and runs of these numbers are runs."""
        return number >= self.lines

    def spans(self) -> np.ndarray:
        """Start * 2^32 + end of each paragraph in code points of the text."""
        starts, ends = self.chars()
        return (starts[self.first] << 32) | ends[self.last - 1]


class Cuts(Cut):
    """The paragraphs of several texts, each cut as by ``Cut`` and in that order, in one pass over all; ``text`` has each one's text number."""

    def __init__(self, texts: list[bytes], config: ParagraphConfig) -> None:
        Words.__init__(self, b"\n".join(texts))
        sizes = np.array([len(t) + 1 for t in texts])
        self.byte = np.cumsum(sizes) - sizes  # where each text begins
        word = np.searchsorted(self.begin, self.byte)
        self.n = len(self.words)
        count = np.append(word[1:], self.n) - word
        of = lambda first: np.searchsorted(word, first, "right") - 1
        self.shingles = _run_hash(self.words, config.shingle) if self.n >= config.shingle else np.zeros(0, np.uint64)
        few = np.flatnonzero((count >= config.shingle) & (count < config.block))
        first, last = self._natural_of(word[count > 0], config.line)
        whole = count[of(first)] >= config.block
        first, last = first[whole], last[whole]
        starts = self._anchors_of(word, count - config.block + 1, config.winnow)
        runs = starts[starts + config.run <= (word + count)[of(starts)]]
        self.first = np.concatenate([word[few], first, starts, runs])
        self.last = np.concatenate([(word + count)[few], last, starts + config.block, runs + config.run])
        kind = np.repeat([0, 0, 1, 2], [len(few), len(first), len(starts), len(runs)])
        text = of(self.first)
        order = np.argsort(text, kind="stable")
        self.first, self.last, self.kind, self.text = self.first[order], self.last[order], kind[order], text[order]

    def _natural_of(self, word: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """``_natural`` of the texts that begin at these words."""
        turn = np.searchsorted(self.begin, np.flatnonzero(self.raw == 10))
        first = np.unique(np.concatenate([word, turn[turn < self.n]]))
        long = np.append(first[1:], self.n) - first >= least
        opens = np.isin(first, word)
        opens[1:] |= long[1:] | long[:-1]
        first = first[opens]
        last = np.append(first[1:], self.n)
        whole = last - first >= least
        return first[whole], last[whole]

    def _anchors_of(self, word: np.ndarray, keys: np.ndarray, winnow: int) -> np.ndarray:
        """``_anchors`` of the texts that have so many ``keys`` from these words on."""
        windows = np.maximum(keys - winnow + 1, 0)
        total = int(windows.sum())
        short = [w + int(self.shingles[w : w + k].argmin()) for w, k in zip(word.tolist(), keys.tolist()) if 0 < k < winnow]
        if not total:
            return np.array(short, np.int64)
        at = np.repeat(word - (np.cumsum(windows) - windows), windows) + np.arange(total)
        views = np.ndarray((len(self.shingles) - winnow + 1, winnow), np.uint64, self.shingles, 0, (8, 8))
        least = (views.argmin(1) + np.arange(len(views)))[at]
        return np.concatenate([least[np.diff(least, prepend=-1) != 0], np.array(short, np.int64)])

    def banded(self) -> np.ndarray:
        return np.flatnonzero(self.kind != 1)

    def is_run(self, number: np.ndarray) -> np.ndarray:
        return self.kind[number] == 2

    def spans(self) -> np.ndarray:
        starts, ends = self.chars()
        begin = self.byte
        if not self.ascii:
            points = np.zeros(len(self.raw) + 1, np.int64)
            np.cumsum((self.raw & 0xC0) != 0x80, out=points[1:])
            begin = points[begin]
        begin = begin[self.text]
        return ((starts[self.first] - begin) << 32) | (ends[self.last - 1] - begin)


#: Bytes of the texts that are cut together; more would not stay in a core's cache.
_TOGETHER = 1 << 16


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): ``version`` is a hash of the text, which tells rows of one doc_id apart."""
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("binary").alias("text")
    )


def cut_texts(docs: DataFrame, config: ParagraphConfig = ParagraphConfig()) -> DataFrame:
    """Rows of two kinds, told apart by ``kind``, from one pass over the texts.

    ``occurrences``: (uid, doc_id, version, span) for every paragraph of every text; ``span`` is its start * 2^32 + end
    in code points. ``signatures``: (uid, version, span, k0, k1, ...) with the band keys of lines and runs; here ``version``
    stands for doc_id and text. A task gives a paragraph's signature once (again only after a million others), so a passage
    that all documents share makes few rows a task.
    """
    names = ["kind", "uid", "doc_id", "version", "span", *[f"k{i}" for i in range(config.bands)]]

    def run(batches):
        seen: set[int] = set()
        occurrences, signatures = _Rows(4), _Rows(3 + config.bands)

        def tables(least):
            if len(occurrences) > least:
                n, (uid, doc, version, span) = occurrences.taken()
                yield pa.RecordBatch.from_arrays([pa.repeat("occurrences", n), uid, doc, version, span, *[pa.nulls(n, pa.int64())] * config.bands], names)
            if len(signatures) > least:
                n, (uid, version, span, *keys) = signatures.taken()
                yield pa.RecordBatch.from_arrays([pa.repeat("signatures", n), uid, pa.nulls(n, pa.int64()), version, span, *keys], names)

        def add(texts, held):
            if len(seen) > 1 << 20:
                seen.clear()
            cut = Cuts(texts, config)
            n = len(cut.first)
            if not n:
                return
            doc, version, place = np.array(held, np.int64).T
            ids, spans, text = cut.ids(), cut.spans(), cut.text
            occurrences.add(n, ids, doc[text], version[text], spans)
            number = cut.banded()
            fresh, at, own = [], -1, []
            for i, x, t in zip(number.tolist(), ids[number].tolist(), text[number].tolist()):
                if t != at:
                    seen.update(own)
                    at, own = t, []
                if x not in seen:
                    fresh.append(i)
                    own.append(x)
            seen.update(own)
            if fresh:
                new, keys = cut.band_keys(config, np.array(fresh, np.int64))
                signatures.add(len(new), ids[new], place[text[new]], spans[new], *keys)

        for batch in batches:
            texts, held, size = [], [], 0
            for *ids, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                texts.append(text)
                held.append(ids)
                size += len(text)
                if size >= _TOGETHER:
                    add(texts, held)
                    texts, held, size = [], [], 0
                    yield from tables(20_000)
            if texts:
                add(texts, held)
        yield from tables(0)

    placed = _texts(docs).select("doc_id", "version", F.xxhash64("doc_id", "version").alias("place"), "text")
    return placed.mapInArrow(run, ", ".join(["kind string", *[f"{c} long" for c in names[1:]]]))


class _Rows:
    """Columns of 64-bit numbers, gathered text by text."""

    def __init__(self, columns: int) -> None:
        self.columns: list[list[np.ndarray]] = [[] for _ in range(columns)]
        self.n = 0

    def __len__(self) -> int:
        return self.n

    def add(self, n: int, *values) -> None:
        """``n`` rows; a single number stands for a column of it."""
        for column, v in zip(self.columns, values):
            column.append(v if isinstance(v, np.ndarray) else np.full(n, v, np.int64))
        self.n += n

    def taken(self) -> tuple[int, list[pa.Array]]:
        n, found = self.n, [pa.array(np.concatenate(c)) for c in self.columns]
        self.__init__(len(self.columns))
        return n, found


def collisions(rows: DataFrame) -> DataFrame:
    """(key, uid) of the buckets that hold different paragraphs, each pair once, from (key, uid, version, span).

    A run is similar to the next ones of its text, which says nothing about other texts. So a bucket is left out if all
    its paragraphs overlap in one text, or, for copies, in the first and in the last of the texts named. Once some do not, more
    paragraphs cannot change that, so a bucket's rows are passed on from there and never gathered: a task holds the undecided ones,
    which overlap in one text and are as few as the paragraphs around one word.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        # rows come sorted by (key, uid, version); ``tail`` is what is undecided of the last key, ``passed`` a decided one and its last uid
        tail, passed = [np.zeros(0, np.int64)] * 4, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([t, c.to_numpy()]) for t, c in zip(tail, batch.columns)]
            if passed:
                own = int(np.searchsorted(held[0], passed[0], "right"))
                uids = held[1][:own]
                new = np.flatnonzero(turns(uids) & (uids != passed[1])) if own else uids
                yield pairs(np.full(len(new), passed[0]), uids[new])
                passed = (passed[0], int(uids[-1])) if own else passed
                held = [x[own:] for x in held]
                tail = held
                if not len(held[0]):
                    continue
                passed = None
            done = int(np.searchsorted(held[0], held[0][-1]))
            yield busy([x[:done] for x in held])
            tail = outermost([x[done:] for x in held])
            # the last paragraph may have more versions to come, which can decide no less
            whole = int(np.searchsorted(tail[1], tail[1][-1]))
            if busy([x[:whole] for x in tail]).num_rows:
                uids = tail[1][turns(tail[1])]
                passed = (int(tail[0][0]), int(uids[-1]))
                yield pairs(np.full(len(uids), passed[0]), uids)
                tail = [x[:0] for x in tail]
        yield busy(tail)

    def pairs(key, uid):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(uid, pa.int64())], ["key", "uid"])

    def turns(*columns):
        """Where any of the columns changes, with the start."""
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
        return new

    def outermost(held):
        """The rows with the first and the last version of each (key, uid)."""
        opens = turns(held[0], held[1])
        keep = opens.copy()
        keep[:-1] |= opens[1:]
        keep[-1:] = True
        return [x[keep] for x in held]

    def busy(held):
        key, uid, version, span = held
        opens = turns(key, uid)
        first = np.flatnonzero(opens)
        if not len(first):
            return pairs(key, uid)
        last = np.append(first[1:], len(key)) - 1
        key, uid = key[first], uid[first]
        bucket = np.flatnonzero(turns(key))
        alone = np.ones(len(bucket), bool)
        for at in (first, last):
            where = version[at]
            same = np.minimum.reduceat(where, bucket) == np.maximum.reduceat(where, bucket)
            meet = np.maximum.reduceat(span[at] >> 32, bucket) < np.minimum.reduceat(span[at] & _LOW, bucket)
            alone &= same & meet
        sizes = np.diff(np.append(bucket, len(key)))
        keep = np.repeat((sizes > 1) & ~alone, sizes)
        return pairs(key[keep], uid[keep])

    return rows.repartition(n, "key").sortWithinPartitions("key", "uid", "version").mapInArrow(run, "key long, uid long")


def distinct_buckets(collided: DataFrame) -> DataFrame:
    """The rows of ``collided`` without buckets that hold the same paragraphs as another one, as those of similar ones in several bands do."""
    parts = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("y")]
    kept = collided.groupBy("key").agg(*parts).groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return collided.join(kept.select("key"), "key", "left_semi")


def jaccard_forest(ids: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Edges of a forest with the components of "Jaccard similarity at least ``threshold``"."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    left = np.ones(len(sets), bool)
    edges = []
    for i in range(len(sets)):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo and left.any():
            j = todo.pop()
            live = left[owner]
            known, asked = sets[j], values[live]
            held = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
            common = np.bincount(owner[live], held, minlength=len(sets))
            near = np.flatnonzero(left & _similar(common, sizes, sizes[j], threshold))
            left[near] = False
            todo.extend(near.tolist())
            edges.extend((ids[i], ids[k]) for k in near.tolist() if ids[i] != ids[k])
    return edges


def _similar(common, size, other, threshold):
    return (common >= threshold * (size + other - common) - 1e-9) & (common > 0)


#: Pairs that are compared together; their numbers take the bits that the shingle hashes leave.
_PAIRS = 1 << 11
#: Buckets of more paragraphs are compared one by one, where a paragraph found similar need not be compared with all others.
_SMALL = 16


def similar_pairs(first: list[np.ndarray], second: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether the sets of each of at most ``_PAIRS`` pairs are similar. All are counted together, by the upper 53 bits of the hashes: one that both sets of a pair hold comes twice."""
    sizes = np.array([[len(x) for x in first], [len(x) for x in second]])
    pair = np.repeat(np.tile(np.arange(len(first), dtype=np.uint64), 2), sizes.ravel())
    keys = np.sort((pair << np.uint64(53)) | (np.concatenate([*first, *second]) >> np.uint64(11)))
    twice = keys[1:][keys[1:] == keys[:-1]]
    common = np.bincount((twice >> np.uint64(53)).astype(np.int64), minlength=len(first))
    return _similar(common, sizes[0], sizes[1], threshold)


def bucket_edges(buckets: list[tuple[list[int], list[np.ndarray]]], threshold: float) -> list[tuple[int, int]]:
    """Edges of forests with the components of each bucket. The pairs of small buckets are compared together, large buckets one by one."""
    edges: list[tuple[int, int]] = []
    pairs = []
    for n, (ids, sets) in enumerate(buckets):
        if len(ids) > _SMALL:
            edges.extend(jaccard_forest(ids, sets, threshold))
        else:
            pairs.extend((n, i, k) for k in range(1, len(ids)) for i in range(k))
    root = [list(range(len(ids))) for ids, _ in buckets]

    def top(of: list[int], i: int) -> int:
        while of[i] != i:
            i = of[i]
        return i

    for at in range(0, len(pairs), _PAIRS):
        part = pairs[at : at + _PAIRS]
        alike = similar_pairs([buckets[n][1][i] for n, i, _ in part], [buckets[n][1][k] for n, _, k in part], threshold)
        for j in np.flatnonzero(alike).tolist():
            n, i, k = part[j]
            a, b = top(root[n], i), top(root[n], k)
            if a != b:
                root[n][max(a, b)] = min(a, b)
                ids = buckets[n][0]
                if ids[i] != ids[k]:
                    edges.append((ids[i], ids[k]))
    return edges


def verified_links(collided: DataFrame, shingles: DataFrame, config: ParagraphConfig = ParagraphConfig()) -> DataFrame:
    """(a, b) among colliding paragraphs whose shingle sets are similar enough; the closure equals that of all similar pairs of a bucket."""
    parts = F.greatest(F.count("*") / config.most, F.sum("size") / config.most_shingles)
    counts = collided.join(shingles.select("uid", "size"), "uid").groupBy("key").agg(F.ceil(parts * 2).cast("int").alias("n")).where("n > 2")
    sized = collided.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = sized.withColumn("i", F.pmod(F.xxhash64("uid"), F.col("n")).cast("int"))
    tasks = dealt.select("key", "uid", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    keyed = tasks.select("uid", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("task"))
    n = int(collided.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        at, ids, sets = None, [], []
        edges: list = []
        held: list = []

        def close():
            nonlocal ids, sets
            if len(ids) > 1:
                held.append((ids, sets))
            ids, sets = [], []

        def found(least):
            if held and sum(len(x) for x, _ in held) > least:
                edges.extend(bucket_edges(held, config.threshold))
                held.clear()
            if len(edges) > least:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in edges], pa.int64()) for k in (0, 1)], ["a", "b"])
                edges.clear()

        for batch in batches:
            for task, uid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if task != at:
                    close()
                    at = task
                ids.append(uid)
                sets.append(np.frombuffer(data.as_py(), np.uint64))
            yield from found(2 * _PAIRS)
        close()
        yield from found(0)

    rows = keyed.join(shingles.select("uid", "shingles"), "uid").select("task", "uid", "shingles")
    return rows.repartition(n, "task").sortWithinPartitions("task", "uid").mapInArrow(run, "a long, b long")


def _distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; for the few of a paragraph in less time than ``np.unique``."""
    values = np.sort(values)
    new = values[1:] != values[:-1]
    return values if new.all() else np.concatenate([values[:1], values[1:][new]])


def shingle_sets(docs: DataFrame, wanted: DataFrame, config: ParagraphConfig = ParagraphConfig()) -> DataFrame:
    """(uid, size, shingles) of the ``wanted`` (uid, doc_id, version) paragraphs; shingles are sorted distinct 64-bit hashes as bytes.

    Repeated rows may give a paragraph twice, which does no harm in ``verified_links``.
    """

    def run(batches):
        for batch in batches:
            uids, blobs = [], []

            def add(texts, needs):
                cut = Cuts(texts, config)
                for uid, t, a, b in zip(cut.ids().tolist(), cut.text.tolist(), cut.first.tolist(), cut.last.tolist()):
                    if uid in needs[t]:
                        needs[t].discard(uid)
                        uids.append(uid)
                        blobs.append(_distinct(cut.shingles[a : b - config.shingle + 1]).tobytes())

            texts, needs, size = [], [], 0
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append(text)
                needs.append(set(want))
                size += len(text)
                if size >= _TOGETHER:
                    add(texts, needs)
                    texts, needs, size = [], [], 0
            if texts:
                add(texts, needs)
            sizes = pa.array([len(b) // 8 for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), sizes, pa.array(blobs, pa.binary())], ["uid", "size", "shingles"])

    lists = wanted.groupBy("doc_id", "version").agg(F.collect_set("uid").alias("want"))
    return _texts(docs).join(lists, ["doc_id", "version"]).select("text", "want").mapInArrow(run, "uid long, size long, shingles binary")


def _placed(text: bytes, spans: list[int]):
    """The text's words, where they start and end, and for each span that begins and ends with words (number, first word, last word + 1)."""
    cut = Words(text)
    starts, ends = cut.chars()
    if not len(starts):
        return cut, starts, ends, []
    a, b = np.array(spans, np.int64) >> 32, np.array(spans, np.int64) & _LOW
    i = np.minimum(np.searchsorted(starts, a), len(starts) - 1)
    j = np.minimum(np.searchsorted(ends, b), len(ends) - 1)
    ok = np.flatnonzero((starts[i] == a) & (ends[j] == b))
    return cut, starts, ends, [(k, int(i[k]), int(j[k]) + 1) for k in ok.tolist()]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items are equal."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _low(span: str):
    return F.col(span).bitwiseAND(F.lit(_LOW))


def _high(span: str):
    return F.shiftright(span, 32)


def chains(hits: DataFrame) -> DataFrame:
    """Occurrences of one text that touch and lie as their kept ones do, as one passage each.

    Columns: doc_id, version, keeper_id, keeper_version, removed, same (its paragraphs equal the kept ones), component_id (the least),
    a and b (code points), ka and kb (of the kept passage), open_left and open_right. Paragraphs overlap many times over, so
    there are far fewer passages than occurrences. An end of a removed passage that is the ``same`` is open if no other such
    passage of the text goes on there, and the text does.
    """
    n = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one exchange serves all windows and aggregates below, since each of their keys includes these
    dealt = hits.repartition(n, "doc_id", "version")
    starts = dealt.select("*", _high("span").alias("a"), _low("span").alias("b"), _high("keeper_span").alias("ka"), _low("keeper_span").alias("kb"))
    # what stays is listed where it is; what goes is aligned with the occurrence that stays
    apart = F.when(F.col("removed"), F.col("a") - F.col("ka")).otherwise(0)
    keys = ["doc_id", "version", "keeper_id", "keeper_version", "removed", "same", "apart"]
    ends = [F.min("component_id").alias("component_id"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("ka").alias("ka"), F.max("kb").alias("kb")]
    joined = _islands(starts.withColumn("apart", apart), keys, 0).groupBy(*keys, "island").agg(*ends).drop("island", "apart")
    text = ["doc_id", "version", "removed", "same"]
    whole = Window.partitionBy(*text, "island")
    is_open = lambda c, f: (F.col("removed") & F.col("same") & (F.col(c) == f(c).over(whole)))
    open_left = is_open("a", F.min) & (F.col("a") > 0)
    return _islands(joined, text, 1).select(*joined.columns, open_left.alias("open_left"), is_open("b", F.max).alias("open_right"))


def _islands(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Number the spans [a, b) of each key so that those ``gap`` characters or less apart share a number; a text's spans are as many as its words at most."""
    order = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("__opens", F.when(F.col("a") <= reach + gap, 0).otherwise(1))
    return opened.withColumn("island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def surroundings(docs: DataFrame, passages: DataFrame, config: ParagraphConfig = ParagraphConfig()) -> DataFrame:
    """(keeper_id, keeper_version, ka, kb, before, after): hashes of the ``winnow`` words on each side of kept passages, nearest first."""

    def run(batches):
        for batch in batches:
            for doc, version, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                cut, _, _, placed = _placed(text.as_py(), [w["ka"] << 32 | w["kb"] for w in want])
                if placed:
                    before = [cut.words[max(0, i - config.winnow) : i][::-1].tobytes() for _, i, _ in placed]
                    after = [cut.words[j : j + config.winnow].tobytes() for _, _, j in placed]
                    ka, kb = ([want[k][c] for k, _, _ in placed] for c in ("ka", "kb"))
                    cells = [[doc] * len(placed), [version] * len(placed), ka, kb]
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cells], pa.array(before, pa.binary()), pa.array(after, pa.binary())], names)

    names = ["keeper_id", "keeper_version", "ka", "kb", "before", "after"]
    heads = passages.where("open_left OR open_right").select(*names[:4]).distinct()
    lists = heads.groupBy(F.col("keeper_id").alias("doc_id"), F.col("keeper_version").alias("version")).agg(F.collect_list(F.struct("ka", "kb")).alias("want"))
    found = _texts(docs).join(lists, ["doc_id", "version"]).select("doc_id", "version", "text", "want")
    schema = "keeper_id long, keeper_version long, ka long, kb long, before binary, after binary"
    return found.mapInArrow(run, schema).dropDuplicates(names[:4])


def extended(docs: DataFrame, passages: DataFrame, around: DataFrame, config: ParagraphConfig = ParagraphConfig()) -> DataFrame:
    """(doc_id, version, keeper_id, component_id, a, b): removed passages with open ends, and the words beside them that equal those of the kept passage.

    Blocks of a common passage begin at most ``winnow`` words apart and from its ends, so ``winnow`` words on each side
    close all gaps. Repeated rows give a passage once.
    """
    names = ["doc_id", "version", "keeper_id", "component_id", "a", "b"]

    def run(batches):
        for batch in batches:
            for doc, version, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                cut, starts, ends, placed = _placed(text.as_py(), [w["a"] << 32 | w["b"] for w in want])
                if not placed:
                    continue
                out = []
                for k, i, j in placed:
                    w = want[k]
                    left = _agree(cut.words[max(0, i - config.winnow) : i][::-1], np.frombuffer(w["before"], np.uint64))
                    right = _agree(cut.words[j : j + config.winnow], np.frombuffer(w["after"], np.uint64))
                    left, right = left * w["open_left"], right * w["open_right"]
                    a = int(starts[i - left])
                    if (w["keeper_id"], w["keeper_version"]) == (doc, version):  # a later repeat in the text that keeps the first
                        a = min(int(starts[i]), max(a, w["kb"]))
                    out.append((doc, version, w["keeper_id"], w["component_id"], a, int(ends[j + right - 1])))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)

    # no aggregate on top, so that adaptive execution can split a passage that very many documents share
    each = passages.where("open_left OR open_right").join(around, ["keeper_id", "keeper_version", "ka", "kb"])
    cells = F.struct("component_id", "keeper_id", "keeper_version", "a", "b", "kb", "open_left", "open_right", "before", "after")
    lists = each.groupBy("doc_id", "version").agg(F.collect_list(cells).alias("want"))
    made = _texts(docs).join(lists, ["doc_id", "version"]).select("doc_id", "version", "text", "want")
    return made.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def repeated(docs: DataFrame, config: ParagraphConfig = ParagraphConfig()) -> DataFrame:
    """One row per passage: paragraphs that repeat, exactly or nearly, across documents, joined where they touch.

    Columns: component_id (of its component, a number; the least where several are joined), first_doc_id (the document whose
    occurrence stays), doc_id, text_key (a hash of the text), start and end (code points), removed. Removed spans of equal
    passages reach over the neighbouring words that equal those of the occurrence that stays, so all of such a passage is listed;
    those of near copies end with their last similar paragraph. Of equal occurrences the one of the least doc_id, then text
    hash and span stays. Texts of any length are cut whole.
    Repeats within one doc_id alone are left. Rows whose doc_id or text is null are left alone, as nothing could name
    them; texts of fewer words than a shingle have no paragraphs. Repeated rows give their passages once. Other columns are ignored; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    hashes = ("uid", "span", *[f"k{i}" for i in range(config.bands)])
    cuts, signatures = scratch.write_kinds(cut_texts(docs, config), "cuts", "occurrences", "signatures", hashes=hashes)
    found = cuts.select("uid", "doc_id", "version", "span")
    # two bands at a time, so that only their keys are on disk twice
    pairs = [[F.col(f"k{j}") for j in range(i, min(i + 2, config.bands))] for i in range(0, config.bands, 2)]
    bands = [scratch.write(collisions(signatures.select(F.explode(F.array(*ks)).alias("key"), "uid", "version", "span")), "collided") for ks in pairs]
    scratch.drop(signatures)
    collided = scratch.write(distinct_buckets(reduce(DataFrame.unionByName, bands)), "buckets")
    scratch.drop(*bands)
    near = collided.select("uid").distinct().withColumn("near", F.lit(True))
    groups = found.groupBy("uid").agg(F.min(F.struct("doc_id", "version", "span")).alias("first"), F.max("doc_id").alias("last_doc"))
    kept = groups.join(near, "uid", "left").where("near OR first.doc_id < last_doc")
    kept = scratch.write(kept.select("uid", "first", "last_doc", F.coalesce("near", F.lit(False)).alias("near")), "paragraphs")
    sets = scratch.write(shingle_sets(docs, kept.where("near").select("uid", "first.doc_id", "first.version"), config), "shingles")
    links = scratch.write(verified_links(collided, sets, config), "links")
    scratch.drop(sets, collided)
    roots = connected_components(links)
    rooted = kept.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    rooted = scratch.write(rooted.select("uid", "root", "first", "last_doc"), "rooted")
    scratch.drop(links, kept)
    head = F.min_by("uid", F.struct("first", "uid")).alias("kept_uid")
    spread = rooted.groupBy("root").agg(F.min("first").alias("keeper"), head, F.max("last_doc").alias("last_doc")).where("keeper.doc_id < last_doc")
    keeper = [F.col(f"keeper.{x}").alias(y) for x, y in (("doc_id", "keeper_id"), ("version", "keeper_version"), ("span", "keeper_span"))]
    same = (F.col("uid") == F.col("kept_uid")).alias("same")
    flagged = scratch.write(rooted.select("uid", "root").join(spread, "root").select("uid", F.col("root").alias("component_id"), *keeper, same), "flagged")
    scratch.drop(rooted)
    # overlapping runs of one text are similar to each other: in the document whose occurrence stays, only its equals after it go
    again = F.col("same") & ((F.col("version") != F.col("keeper_version")) | (_high("span") >= _low("keeper_span")))
    removed = ((F.col("doc_id") != F.col("keeper_id")) | again).alias("removed")
    # no aggregate on this join, so that adaptive execution can split a passage that very many documents share
    # and by hash tables of the few flagged ones, so that the many others needn't be sorted
    hits = found.join(flagged.hint("shuffle_hash"), "uid").select("component_id", *[f"keeper_{x}" for x in ("id", "version", "span")], "doc_id", "version", "span", removed, "same")
    passages = scratch.write(chains(hits), "passages")
    scratch.drop(cuts, flagged)
    around = scratch.write(surroundings(docs, passages, config), "surroundings")
    wide = extended(docs, passages, around, config).withColumn("removed", F.lit(True))
    stay = passages.where("NOT (open_left OR open_right)").distinct().select("doc_id", "version", "keeper_id", "component_id", "a", "b", "removed")
    return wide.unionByName(stay).select(
        "component_id",
        F.col("keeper_id").alias("first_doc_id"),
        "doc_id",
        F.col("version").alias("text_key"),
        F.col("a").cast("int").alias("start"),
        F.col("b").cast("int").alias("end"),
        "removed",
    )


def remove(docs: DataFrame, config: ParagraphConfig = ParagraphConfig()) -> DataFrame:
    """The rows of ``docs`` with removals cut out of ``text``; overlapping removals are cut once, other columns are kept.

    Cuts are named by doc_id and text, so a doc_id that several texts share does no harm; repeated rows are all cut
    alike. Rows with a null doc_id or text, texts without removals and an empty table pass through. A text may become empty.
    """
    cuts = F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts")
    spans = repeated(docs, config).where("removed").groupBy("doc_id", "text_key").agg(cuts)
    keyed = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    joined = keyed.join(spans, ["doc_id", "text_key"], "left")
    text = F.col("row").getField("text")
    # acc: the text so far and where the last cut ended
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    cut = F.aggregate(
        "cuts",
        start,
        lambda acc, c: F.struct(
            F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.greatest(c["start"] - acc["at"], F.lit(0)))).alias("text"),
            F.greatest(acc["at"], c["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    new = F.when(F.col("cuts").isNull(), text).otherwise(cut)
    return joined.select(*[(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
