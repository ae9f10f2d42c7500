"""Personal data: base patterns plus a skip-chain conditional random field over each document.

Base spans come from the four patterns. The field then labels every token that holds a digit or "@"
(all other tokens carry no evidence and are fixed to "none"). Neighbouring tokens share a chain
potential; repeated tokens, tokens whose digits end alike (also where a number is spread over several),
and addresses of one name share a skip potential however far apart they are: each occurrence is linked with a hub, the first one that meets a base span of a kind (one hub
for each kind found), else the first of all. So the evidence of a base span is one link away, any two
occurrences are two links apart, and a value repeated n times costs about n edges. Base spans
clamp their tokens; loopy sum-product message passing, run until its messages settle, spreads them, so
another spelling of a number found once is found throughout the document.

Weights are learned by pseudo-likelihood on a bounded sample of documents, with base spans as labels
and the plus sign and brackets of some hidden, so that context and number shape carry weight too.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaflow.llm.common import text_blocks

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the contract's patterns: the same leftmost matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>"


def _emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return found


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str | None) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in the order of KINDS: leftmost, non-overlapping in a kind, failing matches dropped."""
    if not text or not _ANY.search(text):
        return [[], [], [], []]
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    return [
        _emails(text),
        [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))],
        [m.span() for m in _CARD.finditer(text) if 16 <= len(d := digits(m)) <= 19 and _luhn(d)],
        [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    ]


@dataclass(frozen=True)
class CrfConfig:
    """``train_docs`` documents of at most ``train_chars`` characters bound the training sample.

    Skip potentials have a prior mean of ``same`` for equal labels, since few sampled documents repeat a value.
    """

    train_docs: int = 2000
    train_chars: int = 20_000
    epochs: int = 150
    rate: float = 0.1
    l2: float = 1e-3
    same: float = 6.0
    hide: float = 0.3
    rounds: int = 10
    least: float = 0.9
    seed: int = 17


_WORDS = 64
_BUCKETS = (0, 2, 3, 4, 7, 9, 12, 15, 16, 19)
_HIDDEN = ("plus", "paren")
_NAMES = (
    ["bias", "letters", "hyphen", "equals", "colon", "slash", "hex", "dots1", "dots2", "at", "dots3", "part4", *_HIDDEN]
    + [f"digits{i}" for i in range(len(_BUCKETS) + 1)]
    + [f"run{i}" for i in range(len(_BUCKETS) + 1)]
    + [f"before{i}" for i in range(_WORDS)]
    + [f"after{i}" for i in range(_WORDS)]
)
_INDEX = {name: i for i, name in enumerate(_NAMES)}
_LONG = re.compile(r"[0-9]{4}")
_HEX = re.compile(r"\W*[0-9a-fA-F]{12,}\W*")


def _bucket(n: int) -> int:
    return next((i for i, most in enumerate(_BUCKETS) if n <= most), len(_BUCKETS))


def _ruled_out(word: str) -> int:
    """Bits of the kinds that fail their check: card by the check digit (13 digits or more), ip by a part over 255."""
    core = word.strip(_EDGE)
    digits = re.sub("[^0-9]", "", core)
    card = len(digits) >= 13 and not _luhn(digits)
    ip = bool(m := _IP.fullmatch(core)) and not all(map(_small, m.group().split(".")))
    return card << KINDS.index("card") + 1 | ip << KINDS.index("ip") + 1


class Graph:
    """Nodes and edges of one or more documents; ``spans`` holds each node's token and document."""

    def __init__(self) -> None:
        self.features: list[list[int]] = []
        self.label: list[int] = []
        self.banned: list[int] = []  # bits of kinds that a token's own digits rule out
        self.spans: list[tuple[int, int, int, int]] = []  # document, token number, start, end
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, base: list[list[tuple[int, int]]]) -> None:
        """Add a document's candidate tokens. A token that meets a base span gets its kind (1-4), else 0."""
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        nodes = [i for i, (s, e) in enumerate(tokens) if _ANY.search(text, s, e)]
        if not nodes:
            return
        marks = sorted((s, e, k + 1) for k, spans in enumerate(base) for s, e in spans)
        first, place, alike = len(self.spans), 0, {}
        words = [text[s:e] for s, e in (tokens[i] for i in nodes)]
        counts = [sum(c in "0123456789" for c in w) for w in words]
        runs = list(counts)
        for n in range(1, len(nodes)):
            if nodes[n] == nodes[n - 1] + 1:
                runs[n] += runs[n - 1]
        for n in range(len(nodes) - 2, -1, -1):
            if nodes[n + 1] == nodes[n] + 1:
                runs[n] = runs[n + 1]
        for n, (i, word) in enumerate(zip(nodes, words)):
            start, end = tokens[i]
            while place < len(marks) and marks[place][1] <= start:
                place += 1
            kind = next((k for s, e, k in marks[place : place + 4] if s < end and e > start), 0)
            near = lambda j: zlib.crc32(text[slice(*tokens[j])].lower().strip(_EDGE).encode("utf-8", "replace")) % _WORDS if 0 <= j < len(tokens) else 0
            dots = word.strip(_EDGE).count(".")
            on = [
                ("bias", True), ("letters", any(c.isalpha() for c in word)), ("hyphen", "-" in word), ("equals", "=" in word),
                ("colon", ":" in word), ("slash", "/" in word), ("hex", bool(_HEX.fullmatch(word))), ("dots1", dots == 1), ("dots2", dots == 2),
                ("at", "@" in word), ("plus", word[0] == "+"), ("dots3", dots == 3), ("paren", "(" in word), ("part4", bool(_LONG.search(word))),
            ]
            self.features.append(
                [_INDEX[k] for k, v in on if v]
                + [_INDEX[f"digits{_bucket(counts[n])}"], _INDEX[f"run{_bucket(runs[n])}"], _INDEX[f"before{near(i - 1)}"], _INDEX[f"after{near(i + 1)}"]]
            )
            self.label.append(kind)
            self.banned.append(_ruled_out(word))
            self.spans.append((doc, i, start, end))
            if n and nodes[n - 1] == i - 1:
                self.chain.append((first + n - 1, first + n))
            keys = self._run_keys(words, counts, nodes, n)
            plain = word.strip(_EDGE).lower()
            if len(plain) >= 4 and (counts[n] >= 7 or any(c.isalpha() for c in plain)):  # few digits alone name nothing
                keys.add(plain)
            if counts[n] >= 7:
                keys.add(re.sub("[^0-9]", "", word)[-7:])
            if len(local := plain.partition("@")[0]) >= 4 and "@" in plain:
                keys.add(local)
            for key in keys:
                alike.setdefault(key, []).append(first + n)
        links: dict[tuple[int, int], None] = {}  # ordered, each pair once
        for found in alike.values():
            hubs: dict[int, int] = {}  # by kind
            for n in found:
                if self.label[n]:
                    hubs.setdefault(self.label[n], n)
            for n in found:
                for hub in hubs.values() or found[:1]:
                    if n != hub:
                        links[min(n, hub), max(n, hub)] = None
        self.skip.extend(links)

    @staticmethod
    def _run_keys(words: list[str], counts: list[int], nodes: list[int], n: int) -> set[str]:
        """The last seven digits of a number that is spread over words in a row, of one to six digits each and without letters, which the word is part of."""
        part = lambda i: 0 <= i < len(words) and counts[i] <= 6 and not any(c.isalpha() or c == "@" for c in words[i])
        if not part(n):
            return set()
        first = last = n
        while first > n - 19 and part(first - 1) and nodes[first - 1] == nodes[first] - 1:
            first -= 1
        while last < n + 19 and part(last + 1) and nodes[last + 1] == nodes[last] + 1:
            last += 1
        digits = re.sub("[^0-9]", "", "".join(words[first : last + 1]))
        return {digits[-7:]} if last > first and 7 <= len(digits) <= 19 else set()

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.features), len(_NAMES)))
        for i, on in enumerate(self.features):
            x[i, on] = 1
        return x


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _edge_arrays(graph: Graph) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip))


def train(graph: Graph, config: CrfConfig = CrfConfig()) -> dict[str, np.ndarray]:
    """Node weights, chain and skip potentials by gradient ascent (Adam) on the pseudo-likelihood."""
    n_labels = len(KINDS) + 1
    prior = {"node": 0.0, "chain": 0.0, "skip": config.same * np.eye(n_labels)}
    model = {"node": np.zeros((len(_NAMES), n_labels)), "chain": np.zeros((n_labels, n_labels)), "skip": np.zeros((n_labels, n_labels))}
    model["skip"] += prior["skip"]
    if not graph.label:
        return model
    rng = np.random.default_rng(config.seed)
    x, y = graph.matrix(), np.array(graph.label)
    hidden = rng.random(len(y)) < config.hide
    x[np.ix_(hidden, [_INDEX[k] for k in _HIDDEN])] = 0
    truth = np.eye(n_labels)[y]
    sums = {}
    for name, edges in zip(("chain", "skip"), _edge_arrays(graph)):
        left, right = np.zeros_like(truth), np.zeros_like(truth)  # label counts of the earlier and the later neighbours
        np.add.at(left, edges[:, 1], truth[edges[:, 0]])
        np.add.at(right, edges[:, 0], truth[edges[:, 1]])
        sums[name] = (left, right)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    for t in range(1, config.epochs + 1):
        score = x @ model["node"]
        for name, (left, right) in sums.items():
            score += left @ model[name] + right @ model[name].T
        p = np.exp(score - _log_sum(score, 1)[:, None])
        miss = (truth - p) / len(y)
        grad = {"node": x.T @ miss} | {k: left.T @ miss + miss.T @ right for k, (left, right) in sums.items()}
        for k in model:
            g = grad[k] - config.l2 * (model[k] - prior[k])
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model[k] += config.rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


#: Message passing of a document ends when no message of it changes by more (natural logarithms).
_SETTLED = 1e-4


def marginals(graph: Graph, model: dict[str, np.ndarray], rounds: int = 10) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product with damping; labelled nodes are clamped.

    A document's messages are passed until they settle, for ``rounds`` rounds at least. Steps halve every hundred
    rounds, so messages that swing settle too. A document's result doesn't depend on the others in the graph.
    """
    unary = np.zeros((len(graph.features), model["node"].shape[1]))
    for i, on in enumerate(graph.features):
        unary[i] = model["node"][on].sum(0)
    y = np.array(graph.label)
    given = np.flatnonzero(y)
    # a hub hears many messages, so evidence has to outweigh any number of them
    unary[given] = -1e9
    unary[given, y[given]] = 0.0
    for i, bits in enumerate(graph.banned):
        for kind in range(1, unary.shape[1]) if bits and not y[i] else ():
            unary[i, kind] -= 1e9 * (bits >> kind & 1)
    chain, skip = _edge_arrays(graph)
    source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    if len(source):
        c, s = len(chain), len(skip)
        back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
        factors = [np.exp(m) for m in (model["chain"], model["chain"].T, model["skip"], model["skip"].T)]
        sort = np.repeat(np.arange(4), (c, c, s, s))
        docs = np.array([x[0] for x in graph.spans], np.int64) if graph.spans else np.zeros(len(unary), np.int64)
        doc = docs[source]
        every = np.zeros((len(source), unary.shape[1]))
        at, to, sent = np.arange(len(source)), target, every
        turn, step = 0, 0.5
        while len(at):
            belief = unary.copy()
            np.add.at(belief, to, sent)
            x = belief[source] - sent[back]
            x = np.exp(x - x.max(1, keepdims=True))
            cuts = np.searchsorted(sort, np.arange(5))
            new = np.log(np.concatenate([x[i:j] @ f for i, j, f in zip(cuts[:-1], cuts[1:], factors)]))
            change = step * (new - new.max(1, keepdims=True) - sent)
            sent = sent + change
            turn += 1
            step = 0.5 ** (1 + turn // 100)
            if turn < rounds:
                continue
            live = np.zeros(docs.max() + 1, bool)
            live[doc[np.abs(change).max(1) > _SETTLED]] = True
            keep = live[doc]
            if not keep.all():
                every[at[~keep]] = sent[~keep]
                back = (np.cumsum(keep) - 1)[back[keep]]
                at, to, source, sent, sort, doc = at[keep], to[keep], source[keep], sent[keep], sort[keep], doc[keep]
        np.add.at(unary, target, every)
    return np.exp(unary - _log_sum(unary, 1)[:, None])


def find(texts: list[str | None], model: dict[str, np.ndarray], config: CrfConfig = CrfConfig()) -> list[tuple[list, list]]:
    """For each text its base spans by kind, and the spans by kind that the field adds to them."""
    base = [base_spans(t) for t in texts]
    graph = Graph()
    for d, t in enumerate(texts):
        if t and _ANY.search(t):
            graph.add(d, t, base[d])
    added = [[[], [], [], []] for _ in texts]
    if not graph.spans:
        return list(zip(base, added))
    p = marginals(graph, model, config.rounds)
    best = p.argmax(1)
    open_ = None  # [document, kind, last token, start, end]
    for n, (d, i, s, e) in enumerate(graph.spans):
        kind = 0 if graph.label[n] or p[n, best[n]] < config.least else int(best[n])
        if open_ and (open_[0], open_[1], open_[2] + 1) == (d, kind, i):
            open_[2], open_[4] = i, e
            continue
        _close(open_, texts, added)
        open_ = [d, kind, i, s, e] if kind else None
    _close(open_, texts, added)
    return list(zip(base, added))


def _close(open_, texts, added) -> None:
    if open_:
        d, kind, _, s, e = open_
        inner = texts[d][s:e]
        a = s + len(inner) - len(inner.lstrip(_EDGE))
        b = e - (len(inner) - len(inner.rstrip(_EDGE)))
        if a < b:
            added[d][kind - 1].append((a, b))


def listed(spans: list[list[tuple[int, int]]]) -> str:
    """kind:start:end by kind, then start, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, own in zip(KINDS, spans) for s, e in sorted(own))


def fit(docs: DataFrame, config: CrfConfig = CrfConfig()) -> str:
    """Train on at most ``config.train_docs`` documents that hold a digit or "@"; returns the model as JSON.

    The sample is taken by a hash of doc_id and text: a count gives a threshold, so that about twice the
    bound passes it, and the least hashes of those are used. Training runs in one task on an executor.
    """
    usable = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where(
        (F.length("text") <= config.train_chars) & F.col("text").rlike("[0-9@]")
    )
    total = usable.count()
    share = min(1.0, 2 * config.train_docs / max(total, 1))
    top = int(share * (1 << 31))
    picked = usable.where(F.shiftrightunsigned("h", 33) <= F.lit(top)).orderBy("h", "text").limit(config.train_docs)

    def run(batches):
        graph = Graph()
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                graph.add(n, t, base_spans(t))
                n += 1
        model = train(graph, config)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps({k: np.round(v, 6).tolist() for k, v in model.items()})])], ["model"])

    rows = picked.select("text").repartition(1).mapInArrow(run, "model string").collect()
    return rows[0][0] if rows else json.dumps({k: v.tolist() for k, v in train(Graph(), config).items()})


def _load(model: str) -> dict[str, np.ndarray]:
    return {k: np.array(v) for k, v in json.loads(model).items()}


def detect(docs: DataFrame, config: CrfConfig = CrfConfig(), model: str | None = None) -> DataFrame:
    """One row per document: doc_id, base counts by kind, base_sha256, spans (base and added), n_added, n_spans (all of them).

    Null and empty texts have no spans; texts of any length are searched whole, in time linear in their length but for the field,
    which links tokens by value. Repeated rows give repeated rows; columns besides doc_id and text are ignored; an empty table gives an empty result (and a model without evidence).
    """
    model = model or fit(docs, config)

    def run(batches):
        weights = _load(model)
        for batch in (b.slice(i, j - i) for b in batches for i, j in text_blocks(b.column(1))):
            found = find(batch.column(1).to_pylist(), weights, config)
            columns = [batch.column(0)]
            columns += [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in range(4)]
            columns.append(pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], pa.string()))
            columns.append(pa.array([listed([x + y for x, y in zip(b, a)]) for b, a in found], pa.string()))
            columns.append(pa.array([sum(map(len, a)) for _, a in found], pa.int64()))
            columns.append(pa.array([sum(map(len, b)) + sum(map(len, a)) for b, a in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    )


def masked(text: str | None, spans: list[list[tuple[int, int]]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    if not text:
        return text
    out, at = [], 0
    for s, _, e, kind in sorted((s, -e, e, k) for k, own in zip(KINDS, spans) for s, e in own):
        if e <= at:
            continue
        out += [text[at : max(s, at)], f"[{kind.upper()}]" if s >= at else ""]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, config: CrfConfig = CrfConfig(), model: str | None = None) -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` masked; n_chars, where present, follows the new text.

    Null and empty texts stay as they are; very long ones are masked whole; repeated rows are masked alike; columns of any
    other name pass through; an empty table gives an empty result.
    """
    model = model or fit(docs, config)
    place = docs.columns.index("text")

    def run(batches):
        weights = _load(model)
        for batch in (b.slice(i, j - i) for b in batches for i, j in text_blocks(b.column(place))):
            texts = batch.column(place).to_pylist()
            new = [masked(t, [x + y for x, y in zip(b, a)]) for t, (b, a) in zip(texts, find(texts, weights, config))]
            columns = list(batch.columns)
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
