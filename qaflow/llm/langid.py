"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, followed by
temperature calibration on rows that the regression has not seen. Document frequencies come from all
training rows; the regression itself is fitted on a bounded sample in one task on an executor. The
model's size depends only on the number of languages and ``buckets``, never on the corpus.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    """``per_lang`` rows for each of the ``max_langs`` most frequent languages, at most ``train_docs`` in all, are fitted.

    Where ``train_docs`` doesn't allow that, every language has the same quota, and what rare ones leave goes to the others.
    """

    buckets: int = 1 << 15
    orders: tuple = (1, 2, 3)
    per_lang: int = 800
    train_docs: int = 6000
    max_langs: int = 256
    calibrate_every: int = 5
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


_LETTERS: list[np.ndarray] = []
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_counts(text: str | None, config: LangConfig = LangConfig()) -> np.ndarray | None:
    """Counts by bucket of the whole text's hashed n-grams: lower case, each run of non-letters one space. None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return None
    padded = np.full(len(points) + 2, 32, np.uint32)
    padded[1:-1] = np.where(is_letter, points, np.uint32(32))
    gap = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    p = padded[keep]
    shift = np.uint32(32 - (config.buckets.bit_length() - 1))
    total = np.zeros(config.buckets, np.int64)
    for n in config.orders:
        if len(p) < n:
            continue
        h = np.full(len(p) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ p[k : len(p) - n + 1 + k]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        total += np.bincount((h * _MULTIPLIERS[3]) >> shift, minlength=config.buckets)
    return total


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values (1 + log tf) * idf of unit length."""
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm else values


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], n_classes: int, config: LangConfig = LangConfig()) -> np.ndarray:
    """Weights [buckets + 1, classes]; the last row is the bias. Elastic net: l1 makes them sparse, l2 shrinks them."""
    z = np.zeros((config.buckets + 1, n_classes))
    n = np.zeros_like(z)

    def weights(zi, ni):
        w = -(zi - np.sign(zi) * config.l1) / ((config.beta + np.sqrt(ni)) / config.alpha + config.l2)
        return np.where(np.abs(zi) <= config.l1, 0.0, w)

    for _ in range(config.epochs):
        for (at, values), label in zip(rows, y):
            i = np.append(at, config.buckets)
            x = np.append(values, 1.0)
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            miss = _softmax(x @ w)
            miss[label] -= 1
            g = x[:, None] * miss
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / config.alpha * w
            n[i] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that maximises the likelihood of held-back rows, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t):
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass(frozen=True)
class LangModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def score(self, counts: np.ndarray | None) -> tuple[str, float]:
        """Most probable language and its calibrated probability; ``und`` and 0 without letters or labels."""
        if counts is None or not self.labels:
            return UNKNOWN, 0.0
        at, values = tfidf(counts, self.idf)
        p = _softmax((values @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])

    def to_bytes(self) -> bytes:
        at = np.flatnonzero(self.weights.any(1))
        head = json.dumps({"labels": self.labels, "t": self.temperature, "rows": len(at), "buckets": len(self.idf)}).encode()
        parts = [len(head).to_bytes(4, "little"), head, self.idf.astype("<f4").tobytes(), at.astype("<i4").tobytes(), self.weights[at].astype("<f4").tobytes()]
        return zlib.compress(b"".join(parts), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> LangModel:
        raw = zlib.decompress(data)
        n = int.from_bytes(raw[:4], "little")
        head = json.loads(raw[4 : 4 + n])
        k, rows, buckets = len(head["labels"]), head["rows"], head["buckets"]
        floats = np.frombuffer(raw, np.uint8, offset=4 + n)
        idf = floats[: 4 * buckets].view("<f4").astype(float) if buckets else np.zeros(0)
        at = floats[4 * buckets : 4 * (buckets + rows)].view("<i4")
        weights = np.zeros((buckets + 1, k))
        weights[at] = floats[4 * (buckets + rows) :].view("<f4").reshape(rows, k)
        return cls(head["labels"], idf, weights, head["t"])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows whose crc32 of the doc_id as text is 0 modulo ``folds``; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def document_frequencies(texts: DataFrame, config: LangConfig = LangConfig()) -> tuple[int, np.ndarray]:
    """Rows with letters, and how many of them hold each bucket: summed in each task, then over all tasks."""

    def run(batches):
        seen = np.zeros(config.buckets + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                counts = ngram_counts(t.as_py(), config)
                if counts is not None:
                    seen[:-1] += counts > 0
                    seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(config.buckets + 1, np.int64)
    for bucket, n in rows:
        seen[bucket] = n
    return int(seen[-1]), seen[:-1]


def quota(counts: list[int], config: LangConfig = LangConfig()) -> int:
    """The most rows for each language, up to ``per_lang``, with which all languages together keep to ``train_docs``."""
    left = config.train_docs
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) > left:  # this language and the more frequent ones share what is left
            return min(config.per_lang, max(1, left // (len(counts) - i)))
        left -= n
    return config.per_lang


def draw(rows: DataFrame, counts: dict[str, int], config: LangConfig = LangConfig()) -> DataFrame:
    """The training sample (text, lang): all rows of languages within the quota, then rows of the others in equal shares."""
    most = quota(list(counts.values()), config)
    shares = {k: min(1.0, 1.25 * most / n) for k, n in counts.items()}
    by_lang = lambda of: F.element_at(F.create_map(*[F.lit(x) for k in counts for x in (k, of(k))]), F.col("lang"))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("langid")), 11).cast("double") / F.lit(float(1 << 53))
    drawn = rows.select("text", "lang", u.alias("u"), by_lang(shares.get).alias("share")).where("u < share")
    rank = F.when(by_lang(lambda k: counts[k] <= most), 0.0).otherwise(F.col("u") / F.col("share"))
    return drawn.orderBy(rank, "u", "lang").limit(config.train_docs).select("text", "lang")


def fit(labelled: DataFrame, config: LangConfig = LangConfig()) -> LangModel:
    """Learn from the ``text`` and non-null ``lang`` of ``labelled`` (which also needs ``doc_id`` to draw the sample).

    The sample takes each language's rows below a hash threshold that follows from its count, so no
    language is gathered or sorted as a whole.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.max_langs).collect()
    labels = sorted(r["lang"] for r in counts)
    if not labels:
        return LangModel([], np.zeros(0), np.zeros((1, 0)), 1.0)
    total, seen = document_frequencies(rows, config)
    idf = np.log((1 + total) / (1 + seen)) + 1
    sample = draw(rows, {r["lang"]: r["count"] for r in counts}, config).repartition(1)
    number = {k: i for i, k in enumerate(labels)}

    def run(batches):
        x, y = [], []
        for batch in batches:
            for t, lang in zip(batch.column(0), batch.column(1)):
                c = ngram_counts(t.as_py(), config)
                if c is not None:
                    x.append(tuple(v.astype(k) for v, k in zip(tfidf(c, idf), (np.int32, np.float32))))
                    y.append(number[lang.as_py()])
        # a fixed order, whatever order the rows arrive in
        order = sorted(range(len(y)), key=lambda i: (zlib.crc32(x[i][0].tobytes()), zlib.crc32(x[i][1].tobytes()), y[i]))
        back = order[:: config.calibrate_every]
        fore = [i for n, i in enumerate(order) if n % config.calibrate_every]
        w = ftrl([x[i] for i in fore], [y[i] for i in fore], len(labels), config)
        logits = np.array([x[i][1] @ w[x[i][0]] + w[-1] for i in back]).reshape(len(back), len(labels))
        model = LangModel(labels, idf, w, temperature(logits, np.array([y[i] for i in back], int)))
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])

    made = sample.mapInArrow(run, "model binary").collect()
    return LangModel.from_bytes(bytes(made[0][0])) if made else LangModel([], np.zeros(0), np.zeros((1, 0)), 1.0)


def predict(docs: DataFrame, model: LangModel, config: LangConfig = LangConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``; only the text is looked at."""
    data = model.to_bytes()

    def run(batches):
        m = LangModel.from_bytes(data)
        for batch in batches:
            found = [m.score(ngram_counts(t.as_py(), config)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, config: LangConfig = LangConfig()) -> DataFrame:
    """Learn on the rows that are not held out and predict all rows.

    A text that is null or has no letter is ``und`` with score 0, and so is every row when nothing can
    be learned. Rows with a null doc_id, lang or text are not learned from (a null doc_id is never held
    out). Texts of any length are scored whole; of languages with equal scores the first in alphabetical order is predicted.
    Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    labelled = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    return predict(docs, fit(labelled, config), config)
