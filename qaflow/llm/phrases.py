"""Collocations: phrases of several words whose parts seldom occur apart, per language.

All 1- to max_n-grams are exploded into rows and hash-aggregated, one job for each length. Most phrases occur once or twice and
their strings are long, so rows carry 96 bits of hash of language and words (two of 10^12 different phrases share them
in one of 10^5 corpora) and the number of a text they stand in; the words of the frequent ones are then read from one text
each. Prefix and suffix counts come by join, scores are exact decimals, and phrases that mostly stand inside a longer one
go by an anti-join with its parts one word shorter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaflow.llm.common import Scratch, text_blocks


@dataclass(frozen=True)
class PhraseConfig:
    """Parameters."""

    max_n: int = 4
    least: int = 30
    #: A candidate goes if a longer one that holds it has at least this percentage of its occurrences.
    absorbed: int = 80
    #: A score of 1 in whole numbers; twice the occurrences are divided by those of both parts.
    unit: int = 1_000_000
    top: int = 2000


#: Bytes as they count: A-Z in lower case, tabs as spaces, whatever ends a stretch as line feeds. No byte of a longer character is touched.
_ENDS = ".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(f"{ascii_uppercase}\t{_ENDS}".encode(), (ascii_lowercase + " " + "\n" * len(_ENDS)).encode())
_TABLED = 48
_RANDOM = np.random.default_rng(7)
_TABLES = [_RANDOM.integers(0, 1 << 64, (_TABLED, 256), np.uint64) for _ in range(2)]
_FACTORS = _RANDOM.integers(0, 1 << 63, (2, 64), np.uint64) * np.uint64(2) + np.uint64(1)
_ROWS = "k1 long, k2 int, rid long"


class Grams:
    """Words of a block of texts as arrays, and hashes of the phrases that they form.

    A word's hash is by tabulation: a number drawn for each place and byte, combined by XOR; longer words are hashed by BLAKE2.
    """

    def __init__(self, texts: list[bytes | None], langs: list[str]) -> None:
        parts = [t or b"" for t in texts]
        self.data = b"\n".join(parts).translate(_CLEAN)
        a = np.frombuffer(self.data, np.uint8)
        inside = (a != 32) & (a != 10)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.stretch = np.cumsum(a == 10)[self.starts] if len(a) else edges
        ends = np.cumsum([len(p) + 1 for p in parts])
        self.text = np.searchsorted(ends, self.starts, "right")
        numbers = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        self.lang = np.array([numbers[x] for x in langs], np.uint64)
        size = self.ends - self.starts
        begins = np.cumsum(size) - size
        places = np.minimum(np.arange(size.sum()) - np.repeat(begins, size), _TABLED - 1)
        letters = a[inside]
        self.hashes = [np.bitwise_xor.reduceat(t[places, letters], begins) if len(size) else np.zeros(0, np.uint64) for t in _TABLES]
        for w in np.flatnonzero(size > _TABLED).tolist():
            digest = hashlib.blake2b(self.data[self.starts[w] : self.ends[w]], digest_size=16).digest()
            for i in range(2):
                self.hashes[i][w] = int.from_bytes(digest[8 * i : 8 * i + 8], "little")

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, k1, k2) of every place where ``n`` words stand in a row."""
        last = len(self.starts) - n + 1
        at = np.flatnonzero(self.stretch[:last] == self.stretch[n - 1 :]) if last > 0 else np.zeros(0, np.int64)
        keys = []
        for h, f in zip(self.hashes, _FACTORS):
            k = self.lang[self.text[at]] * f[0] + np.uint64(n)
            for j in range(n):
                k += h[at + j] * f[j + 2]
            k ^= k >> np.uint64(32)
            k *= f[-1]
            keys.append(k ^ (k >> np.uint64(29)))
        return at, keys[0].view(np.int64), (keys[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def spelled(self, word: int, n: int) -> str:
        return b" ".join(self.data[self.starts[w] : self.ends[w]] for w in range(word, word + n)).decode()


def numbered_texts(docs: DataFrame) -> DataFrame:
    """(rid, lang, text): rows with a number, to be written before use; null lang is ``und`` and the text is bytes."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def _blocks(batches):
    """(batch, Grams) of blocks of rows."""
    for batch in batches:
        for a, b in text_blocks(batch.column("text"), 1 << 19):
            part = batch.slice(a, b - a)
            yield part, Grams(part.column("text").to_pylist(), part.column("lang").to_pylist())


def phrase_rows(texts: DataFrame, n: int) -> DataFrame:
    """(k1, k2, rid): a row for each place where ``n`` words stand in a row within a stretch."""

    def run(batches):
        for part, grams in _blocks(batches):
            at, k1, k2 = grams.phrases(n)
            rid = part.column("rid").to_numpy()[grams.text[at]]
            for i in range(0, len(at), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in (k1, k2, rid)], ["k1", "k2", "rid"])

    return texts.mapInArrow(run, _ROWS)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences."""

    def run(batches):
        for part, grams in _blocks(batches):
            counts = np.bincount(grams.text, minlength=len(part))
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(counts)], ["lang", "n"])

    return texts.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")


def _spelled(rows: DataFrame) -> DataFrame:
    """(lang, n, phrase, f) from texts with the phrases wanted of each: ``wanted`` array<struct<n, k1, k2, f>>."""

    def run(batches):
        for part, grams in _blocks(batches):
            wanted = part.column("wanted").to_pylist()
            langs, out = part.column("lang").to_pylist(), []
            for n in sorted({w["n"] for ws in wanted for w in ws}):
                left = {(i, w["k1"], w["k2"]): w["f"] for i, ws in enumerate(wanted) for w in ws if w["n"] == n}
                at, k1, k2 = grams.phrases(n)
                texts = grams.text[at]
                # keys differ by text, so that only what is wanted of the same text is looked at
                own = lambda k, t: k.view(np.uint64) + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                i, k = (np.array(x, np.int64) for x in zip(*[(i, k) for i, k, _ in left]))
                for place in np.flatnonzero(np.isin(own(k1, texts), own(k, i))).tolist():
                    f = left.pop((int(texts[place]), int(k1[place]), int(k2[place])), None)
                    if f is not None:
                        out.append((langs[texts[place]], n, grams.spelled(int(at[place]), n), f))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "n", "phrase", "f"])

    return rows.mapInArrow(run, "lang string, n int, phrase string, f long")


def phrase_counts(texts: DataFrame, config: PhraseConfig, scratch: Scratch) -> DataFrame:
    """(lang, n, phrase, f) of all phrases of 1 to max_n words with at least ``least`` occurrences within stretches, overlaps included.

    ``texts`` is a written table of ``numbered_texts``. A text spells at most the phrases that it holds.
    """
    tables = []
    for n in range(1, config.max_n + 1):
        counts = phrase_rows(texts, n).groupBy("k1", "k2").agg(F.count("*").alias("f"), F.min("rid").alias("rid"))
        frequent = counts.where(F.col("f") >= config.least).select("rid", F.struct(F.lit(n).alias("n"), "k1", "k2", "f").alias("w"))
        tables.append(scratch.write(frequent, "phrase-hashes"))
    wanted = reduce(DataFrame.unionByName, tables).groupBy("rid").agg(F.collect_list("w").alias("wanted"))
    counts = scratch.write(_spelled(texts.join(wanted, "rid").select("lang", "text", "wanted")), "phrases")
    scratch.drop(*tables)
    return counts


def scored(counts: DataFrame, config: PhraseConfig) -> DataFrame:
    """(lang, n_phrase, phrase, a, l, r, score): every phrase of two words or more with its lowest-scoring cut, the earliest of equals."""
    cuts = (
        counts.where("n > 1")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
        .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)"))
        .withColumnRenamed("f", "a")
    )
    prefix = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    suffix = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"(cast(a as decimal(20, 0)) * {2 * config.unit}) div (cast(l as decimal(20, 0)) + r)").alias("score")
    both = cuts.join(prefix, ["lang", "first"]).join(suffix, ["lang", "rest"])
    best = both.select("lang", "n", "phrase", "a", F.struct(score, "k", "l", "r").alias("cut")).groupBy("lang", "n", "phrase", "a").agg(F.min("cut").alias("cut"))
    return best.select("lang", F.col("n").alias("n_phrase"), "phrase", "a", "cut.l", "cut.r", "cut.score")


def without_parts(candidates: DataFrame, config: PhraseConfig) -> DataFrame:
    """Candidates that no longer one holds with at least ``absorbed`` percent of their occurrences.

    Extensions by one word are enough: what stands between a candidate and a longer one around it occurs at least as often as
    the longer one, so it is a candidate too and absorbs no less.
    """
    longer = candidates.where("n_phrase > 2")
    head = F.expr("substring_index(phrase, ' ', n_phrase - 1)")
    tail = F.expr("substring(phrase, char_length(substring_index(phrase, ' ', 1)) + 2)")
    parts = longer.select("lang", F.explode(F.array(head, tail)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    c, p = candidates.alias("c"), parts.alias("p")
    held = (F.col("c.lang") == F.col("p.lang")) & (F.col("c.phrase") == F.col("p.phrase"))
    exact = [F.col(x).cast("decimal(20, 0)") for x in ("p.longer", "c.a")]
    return c.join(p, held & (exact[0] * 100 >= exact[1] * config.absorbed), "left_anti")


def collocations(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Ranked by score, then occurrences, both descending, then the phrase's bytes, so ties have one order. n counts all word
    occurrences of the language. Null and empty texts give no words, null lang counts as ``und``; texts of any length
    are cut whole; repeated rows count each time; extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    texts = scratch.write(numbered_texts(docs), "texts")
    sizes = scratch.write(word_counts(texts), "word-counts")
    counts = phrase_counts(texts, config, scratch)
    scratch.drop(texts)
    candidates = scratch.write(scored(counts, config), "candidates")
    scratch.drop(counts)
    order = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").alias("rank")
    ranked = without_parts(candidates, config).select("*", order).where(F.col("rank") <= config.top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
