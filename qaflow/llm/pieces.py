"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut wherever two neighbouring characters stand side by side in no piece of the vocabulary: no merge can reach
over such a cut, so the parts ("words" below) are independent. The words of a batch lie in flat numpy arrays of symbols. In
each round every word finds the least rank of its pairs by a segmented minimum, all its pairs of that rank are merged at
once, the leftmost first where they overlap, and the arrays are compacted; words without a pair leave. A word of thousands
of symbols keeps its positions by rank instead, so that a round touches only the pairs that it merges.

Merging all pairs of a rank at once equals the one-by-one order unless a merge makes a pair that ranks no later than itself.
Which pieces can be part of such a pair is known from the vocabulary; where one does make such a pair (a run of spaces, say),
its word is finished pair by pair with a heap.
"""

from __future__ import annotations

import codecs
import hashlib
from heapq import heappop, heappush
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaflow.llm.common import text_blocks

#: Fixed values of the model format: the mark that stands for a space, kinds of pieces, field numbers of the model's messages.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
FIELDS = {"pieces": 1, "trainer_spec": 2, "normalizer_spec": 3}
PIECE_FIELDS = {"piece": 1, "score": 2, "type": 3}
TRAINER_FIELDS = {"model_type": 3, "whitespace_as_suffix": 24, "byte_fallback": 35}
NORMALIZER_FIELDS = {"charsmap": 2, "add_dummy_prefix": 3, "remove_extra_whitespaces": 4, "escape_whitespaces": 5}
BPE = 2

_NONE = np.iinfo(np.int32).max
#: Words of more symbols are merged one at a time, by positions of each rank.
_LONG = 1024


def _fields(data: bytes):
    """(number, value) of a serialized message: integers, bytes, or four raw bytes."""
    at = 0

    def integer():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = integer()
        kind = key & 7
        if kind == 0:
            yield key >> 3, integer()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = integer()
        yield key >> 3, data[at : at + size]
        at += size


def _settings(data: bytes, names: dict[str, int], **defaults):
    found, numbers = dict(defaults), {v: k for k, v in names.items()}
    found.update((numbers[n], v) for n, v in _fields(data) if n in numbers)
    return found


class Model:
    """Pieces and settings of a BPE model file."""

    def __init__(self, data: bytes) -> None:
        pieces, trainer, normalizer = [], b"", b""
        for number, value in _fields(data):
            if number == FIELDS["pieces"]:
                pieces.append(_settings(value, PIECE_FIELDS, piece=b"", score=b"\0\0\0\0", type=NORMAL))
            elif number == FIELDS["trainer_spec"]:
                trainer = value
            elif number == FIELDS["normalizer_spec"]:
                normalizer = value
        self.pieces = [x["piece"].decode("utf-8") for x in pieces]
        self.scores = np.frombuffer(b"".join(x["score"] for x in pieces), "<f4")
        self.types = [x["type"] for x in pieces]
        settings = _settings(trainer, TRAINER_FIELDS, model_type=1, whitespace_as_suffix=0, byte_fallback=0)
        rules = _settings(normalizer, NORMALIZER_FIELDS, charsmap=b"", add_dummy_prefix=1, remove_extra_whitespaces=1, escape_whitespaces=1)
        self.dummy_prefix = bool(rules["add_dummy_prefix"])
        plain = not rules["charsmap"] and not rules["remove_extra_whitespaces"] and rules["escape_whitespaces"] and not settings["whitespace_as_suffix"]
        if settings["model_type"] != BPE or not settings["byte_fallback"] or not plain or {USER_DEFINED, UNUSED} & set(self.types):
            raise ValueError("only BPE models with byte fallback, without normalization and without user-defined or unused pieces are supported")


class Tables:
    """What encoding and decoding look up.

    Symbols are ids of pieces, or numbers beyond them for characters that only occur inside pieces; -1 is any other character.
    """

    def __init__(self, model: Model) -> None:
        self.dummy_prefix = model.dummy_prefix
        n = len(model.pieces)
        symbol = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == NORMAL}
        parts = [p for p in symbol if len(p) > 1]
        letters = sorted(set(chain.from_iterable(symbol)))
        for c in letters:
            symbol.setdefault(c, n + len(symbol))
        codes = np.frombuffer("".join(letters).encode("utf-32-le"), "<u4")
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[codes] = [symbol[c] for c in letters]
        # characters of longer pieces get numbers from 1 on; joined[a, b] says that a piece has them side by side
        inside = sorted(set(chain.from_iterable(parts)))
        self.letter_of = np.zeros(0x110000, np.int32)
        self.letter_of[np.frombuffer("".join(inside).encode("utf-32-le"), "<u4")] = np.arange(1, len(inside) + 1)
        self.width = len(inside) + 1
        joined = np.zeros(self.width * self.width, bool)
        number = {c: i for i, c in enumerate(inside, 1)}
        joined[[number[a] * self.width + number[b] for p in parts for a, b in pairwise(p)]] = True
        self.joined = joined
        # equal scores share a rank, and the leftmost of their pairs goes first
        self.rank_of = np.append(np.unique(-model.scores, return_inverse=True)[1].astype(np.int32), np.int32(_NONE))  # the last for -1
        splits = [
            (symbol[p[:k]], symbol[p[k:]], symbol[p]) for p in parts for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol
        ]
        left, right, whole = np.array(splits, np.int64).reshape(-1, 3).T
        self.base = max(symbol.values(), default=0) + 1
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.whole = np.append(keys[order], np.iinfo(np.int64).max), np.append(whole[order], -1).astype(np.int32)
        self.merge = dict(zip(self.keys.tolist()[:-1], self.whole.tolist()))
        self.ranks = self.rank_of.tolist()
        self.risky = np.zeros(n + 1, bool)
        for part in (left, right):
            made = part < n
            early = self.rank_of[whole[made]] <= self.rank_of[part[made]]
            multi = np.array([len(p) > 1 for p in model.pieces])[part[made]]
            self.risky[part[made][early & multi]] = True
        self.bytes_of = np.full(256, -1, np.int64)
        self.surface = [p.replace(SPACE, " ").encode("utf-8") for p in model.pieces]
        for i, t in enumerate(model.types):
            if t == BYTE:
                value = int(model.pieces[i][3:-1], 16)
                self.bytes_of[value], self.surface[i] = i, bytes([value])
            elif t == CONTROL:
                self.surface[i] = b""
            elif t == UNKNOWN:
                self.surface[i] = " ⁇ ".encode()
        self.names = [str(i) for i in range(n)]
        self.spaced = [p.startswith(SPACE) for p in model.pieces]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbol that each pair merges into, or -1."""
        keys = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.base + b)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.whole[at], np.int32(-1))


def _leftmost(at: np.ndarray) -> np.ndarray:
    """Of ascending positions, those that stay when each one kept rules its next position out."""
    if len(at) < 2:
        return at
    begins = np.append(True, np.diff(at) != 1)
    run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    return at[(np.arange(len(at)) - run) % 2 == 0]


def _settled(tables: Tables, rank: np.ndarray, left: np.ndarray, whole: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merges whose new pairs, with the symbol on either side (-1: none), both rank after the merge itself."""
    return (tables.rank_of[tables.pairs(left, whole)] > rank) & (tables.rank_of[tables.pairs(whole, right)] > rank)


def merge_one(tables: Tables, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of one word, and the position at which each began; one pair at a time, by rank and then from the left."""
    n, flat, base = len(symbols), symbols.tolist(), tables.base
    merge, rank_of = tables.merge, tables.ranks
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []

    def push(i: int, j: int) -> None:
        if flat[i] >= 0 and flat[j] >= 0 and (whole := merge.get(flat[i] * base + flat[j])) is not None:
            heappush(queue, (rank_of[whole], i, j, flat[i], flat[j], whole))

    for i in range(n - 1):
        push(i, i + 1)
    while queue:
        _, i, j, a, b, whole = heappop(queue)
        if flat[i] != a or after[i] != j or flat[j] != b:
            continue  # a merge has changed this pair since
        flat[i], flat[j] = whole, -1
        k = after[i] = after[j]
        after[j] = n
        if k < n:
            before[k] = i
            push(i, k)
        if (h := before[i]) >= 0:
            push(h, i)
    places, i = [], 0
    while i < n:
        places.append(i)
        i = after[i]
    places = np.array(places, np.int64)
    return np.array(flat, np.int32)[places], places


def merge_rounds(tables: Tables, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left when no pair remains in any word, and the flat position at which each began.

    ``starts`` are the words' first positions, ascending from 0; every word has a symbol.
    """
    place = np.arange(len(symbols))
    word = np.zeros(len(symbols), np.int64)
    word[starts[1:]] = 1
    word = np.cumsum(word)
    merged = np.full(len(symbols), -1, np.int32)  # what the symbol at a position and the next one of its word give
    inner = np.flatnonzero(word[:-1] == word[1:])
    merged[inner] = tables.pairs(symbols[inner], symbols[inner + 1])
    out_symbols, out_places = [], []
    while len(symbols):
        ranks = tables.rank_of[merged]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(first, len(word)))
        least = np.minimum.reduceat(ranks, first)
        ended, single = least == _NONE, np.zeros(len(first), bool)
        at = _leftmost(np.flatnonzero((ranks == np.repeat(least, size)) & (ranks < _NONE)))
        if len(doubtful := at[tables.risky[merged[at]]]):
            # the symbols beside each doubtful merge: the left one as it will be, the right one as it is
            taken = np.zeros(len(symbols) + 1, bool)
            taken[at] = True
            w, i = word[doubtful], doubtful - 1
            through = (i > 0) & taken[i - 1]
            left = np.where((i >= 0) & (word[i] == w), np.where(through, merged[i - 1], symbols[i]), -1)
            j = np.minimum(doubtful + 2, len(word) - 1)
            right = np.where((doubtful + 2 < len(word)) & (word[j] == w), symbols[j], -1)
            bad = np.unique(w[~_settled(tables, ranks[doubtful], left, merged[doubtful], right)])
            if len(bad):
                group = np.searchsorted(word[first], bad)
                for g in group.tolist():
                    a, n = first[g], size[g]
                    one, where = merge_one(tables, symbols[a : a + n])
                    out_symbols.append(one)
                    out_places.append(place[a : a + n][where])
                single[group] = True
                at = at[~np.repeat(single, size)[at]]
        quiet = np.repeat(ended, size)
        out_symbols.append(symbols[quiet])
        out_places.append(place[quiet])
        kept = np.repeat(~(ended | single), size)
        symbols[at] = merged[at]
        kept[at + 1] = False
        moved = np.zeros(len(symbols), bool)
        moved[at] = True
        symbols, place, word, merged, moved = symbols[kept], place[kept], word[kept], merged[kept], moved[kept]
        # only pairs with a merged symbol on either side have changed
        changed = moved.copy()
        changed[:-1] |= moved[1:]
        i = np.flatnonzero(changed)
        merged[i] = -1
        i = i[i + 1 < len(word)]
        i = i[word[i] == word[i + 1]]
        merged[i] = tables.pairs(symbols[i], symbols[i + 1])
    symbols, place = np.concatenate([*out_symbols, symbols]), np.concatenate([*out_places, place])
    order = np.argsort(place)
    return symbols[order], place[order]


def merge_long(tables: Tables, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``merge_rounds`` for one word; a round costs what it merges, whatever the word's length."""
    n = len(symbols)
    symbols = np.append(symbols, np.int32(-1))
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    live = np.ones(n, bool)
    merged = np.full(n + 1, -1, np.int32)
    merged[: n - 1] = tables.pairs(symbols[: n - 1], symbols[1:n])
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def push(at: np.ndarray) -> None:
        at = at[merged[at] >= 0]
        ranks = tables.rank_of[merged[at]]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        for group in np.split(at, np.flatnonzero(np.diff(ranks)) + 1) if len(at) else []:
            rank = int(tables.rank_of[merged[group[0]]])
            if rank not in waiting:
                waiting[rank] = []
                heappush(queue, rank)
            waiting[rank].append(group)

    push(np.arange(n))
    while queue:
        rank = heappop(queue)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        at = at[(merged[at] >= 0) & (tables.rank_of[merged[at]] == rank)]  # the rest has changed since
        if not len(at):
            continue
        # overlapping pairs are neighbours in the list of live positions
        chained = np.append(False, after[at[:-1]] == at[1:])
        run = np.flatnonzero(~chained)[np.cumsum(~chained) - 1]
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        left, gone = before[at], after[at]
        if tables.risky[merged[at]].any():
            through = np.append(False, after[gone[:-1]] == at[1:])
            beside = np.where(through, np.append(np.int32(-1), merged[at[:-1]]), np.where(left >= 0, symbols[left], -1))
            if not _settled(tables, np.full(len(at), rank), beside, merged[at], symbols[after[gone]]).all():
                places = np.flatnonzero(live)
                rest, where = merge_one(tables, symbols[places])
                return rest, places[where]
        nxt = after[gone]
        symbols[at] = merged[at]
        symbols[gone] = -1
        live[gone] = False
        merged[at] = merged[gone] = -1
        after[at] = nxt
        before[nxt] = at
        # pairs to the left and to the right of each merged symbol
        left = before[at]
        touched = np.unique(np.concatenate([at[nxt < n], left[left >= 0]]))
        merged[touched] = tables.pairs(symbols[touched], symbols[after[touched]])
        push(touched)
    places = np.flatnonzero(live)
    return symbols[places], places


#: An odd number whose powers, times a number drawn for each character, give hashes of words.
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the factor and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, factor in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            grown = np.full(1 << (n - 1).bit_length(), factor, np.uint64)
            grown[0] = 1
            _POWERS[i] = np.cumprod(grown)
    return [x[:n] for x in _POWERS]


class Encoder:
    """Encoder and decoder for one model file.

    Ids of words of up to 64 characters are kept; beyond ``cache_size`` words the store is emptied.
    """

    def __init__(self, path: str, cache_size: int = 800_000) -> None:
        with open(path, "rb") as file:
            self.tables = Tables(Model(file.read()))
        self.noise = np.random.default_rng(1).integers(0, 1 << 64, 0x110000, np.uint64)
        self.cache_size = cache_size
        self.known: dict[str, int] = {}  # where a word's ids begin in the store, and how many they are in the lower 32 bits
        self.store, self.used = np.zeros(1 << 12, np.int32), 0

    def _ids(self, symbols: np.ndarray, places: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has; characters without a piece give the ids of their bytes."""
        cuts = np.append(np.searchsorted(places, starts), len(symbols))
        unknown = (symbols < 0) | (symbols >= len(self.tables.names))
        if not unknown.any():
            return symbols, np.diff(cuts)
        letters = codes[places[unknown]]
        width = np.ones(len(symbols), np.int64)
        width[unknown] = np.digitize(letters, (0x80, 0x800, 0x10000)) + 1
        out = np.repeat(symbols, width)
        out[np.repeat(unknown, width)] = self.tables.bytes_of[np.frombuffer(letters.tobytes().decode("utf-32-le").encode(), np.uint8)]
        return out, np.diff(np.append(0, np.cumsum(width))[cuts])

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has; no word may be empty."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(size) - size
        symbols = self.tables.symbol_of[codes]
        parts = []
        for i in np.flatnonzero(size > _LONG).tolist():
            a = starts[i]
            rest, where = merge_long(self.tables, symbols[a : a + size[i]])
            parts.append((rest, where + a))
        if parts:
            short = np.repeat(size <= _LONG, size)
            back = np.flatnonzero(short)
            if len(back):
                rest, where = merge_rounds(self.tables, symbols[short], np.searchsorted(back, starts[size <= _LONG]))
                parts.append((rest, back[where]))
            symbols, places = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(places)
            symbols, places = symbols[order], places[order]
        else:
            symbols, places = merge_rounds(self.tables, symbols, starts)
        return self._ids(symbols, places, codes, starts)

    def _distinct(self, codes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words that stand for all equal ones, and for each word the index of its own among them."""
        powers, inverse = _powers(len(codes))
        total = np.append(np.uint64(0), np.cumsum(self.noise[codes] * powers))
        hashes = (total[starts + size] - total[starts]) * inverse[starts]
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        stands = first[which]
        same = size[stands] == size
        if same.all():
            shift = np.repeat(starts[stands] - starts, size)
            same = codes == codes[np.arange(len(codes)) + shift]
        if not same.all():  # two words share a hash: compare the words themselves
            words = np.array([codes[a : a + n].tobytes() for a, n in zip(starts.tolist(), size.tolist())], object)
            _, first, which = np.unique(words, return_index=True, return_inverse=True)
        return first, which

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and the last one's end; null and empty texts have none."""
        prefix = SPACE if self.tables.dummy_prefix else ""
        marked = [prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        flat = "".join(marked)
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ends = np.cumsum([len(t) for t in marked])
        codes = np.frombuffer(flat.encode("utf-32-le"), "<u4")
        letters = self.tables.letter_of[codes]
        cut = np.append(True, ~self.tables.joined[letters[:-1] * self.tables.width + letters[1:]])
        cut[ends[ends < len(cut)]] = True
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, len(codes)))
        first, which = self._distinct(codes, starts, size)
        begin, counts = (x[which] for x in self._words([flat[a : a + n] for a, n in zip(starts[first].tolist(), size[first].tolist())]))
        bounds = np.append(0, np.cumsum(counts))
        out = self.store[np.repeat(begin - bounds[:-1], counts) + np.arange(bounds[-1])]
        return out, np.append(0, bounds[np.searchsorted(starts, ends)])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the store the ids of different words begin, and how many each has; words that it lacks are merged."""
        if len(self.known) > self.cache_size:
            self.rest()
        found = np.array(list(map(self.known.get, words, repeat(-1))), np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            lacking = [words[i] for i in missing.tolist()]
            ids, counts = self.merge_words(lacking)
            if self.used + len(ids) > len(self.store):
                self.store = np.append(self.store[: self.used], np.zeros(self.used + 2 * len(ids), np.int32))
            self.store[self.used : self.used + len(ids)] = ids
            found[missing] = (self.used + np.cumsum(counts) - counts) << 32 | counts
            self.used += len(ids)
            self.known.update((w, at) for w, at in zip(lacking, found[missing].tolist()) if len(w) <= 64)
        return found >> 32, found & 0xFFFFFFFF

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def rest(self) -> None:
        """Empty the store."""
        self.known = {}
        self.store, self.used = np.zeros(1 << 12, np.int32), 0

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids. The mark before the text goes; bytes that are no UTF-8 become U+FFFD, each one."""
        data = b"".join(map(self.tables.surface.__getitem__, ids))
        if self.tables.dummy_prefix and (first := next((i for i in ids if self.tables.surface[i]), None)) is not None and self.tables.spaced[first]:
            data = data[1:]
        return data.decode("utf-8", "each-byte")


codecs.register_error("each-byte", lambda e: ("\ufffd", e.start + 1))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(*key) -> Encoder:
    """One encoder per worker process and setting."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "piece_ids", cache_size: int = 400_000) -> DataFrame:
    """Every row of ``docs`` with its ids as ``array<int>`` in a new last column ``ids``.

    Null and empty texts give an empty array; very long ones are encoded whole. Repeated rows stay. Other columns pass
    through unchanged; a column of the name ``ids`` is replaced. An empty table gives an empty result. ``path`` must exist on
    every executor, as the installed vocabularies do.
    """
    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        encoder = _encoder(path, cache_size)
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for a, b in text_blocks(batch.column(place), 2 << 20):
                part = batch.slice(a, b - a)
                found, bounds = encoder.encode_batch(part.column(place).to_pylist())
                encoded = pa.ListArray.from_arrays(bounds.astype(np.int32), found)
                yield pa.RecordBatch.from_arrays([*part.columns, encoded], [*kept, ids])

    return docs.select(*kept).mapInArrow(run, schema)


def decode_documents(rows: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """Every row with the text of its ids in a new last column ``text``; null ids give null, no ids the empty text.

    A column of the name ``text`` is replaced; other columns pass through. Ids must lie in the vocabulary.
    """
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(*kept).schema.add(text, T.StringType())

    def run(batches):
        encoder = _encoder(path, 1)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text])

    return rows.select(*kept).mapInArrow(run, schema)


def digest_documents(docs: DataFrame, path: str, cache_size: int = 800_000) -> DataFrame:
    """Encode, decode the ids again, and return one row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Digests are lowercase hex: of the decimal ids joined by commas, and of the decoded text in UTF-8. Null and empty texts
    have no tokens and the digests of nothing. Very long texts are encoded whole. Repeated rows give repeated rows; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        encoder = _encoder(path, cache_size)
        name = encoder.tables.names.__getitem__
        for batch in batches:
            for a, b in text_blocks(batch.column(1), 2 << 20):
                part = batch.slice(a, b - a)
                found, bounds = encoder.encode_batch(part.column(1).to_pylist())
                encoded = [found[i:j].tolist() for i, j in pairwise(bounds.tolist())]
                columns = [
                    part.column(0),
                    pa.array(map(len, encoded), pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest() for ids in encoded], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(ids).encode()).hexdigest() for ids in encoded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
