import random
import re
from collections import Counter

import pytest

from qaflow.llm import phrases
from tests.llm.cases import documents, empty, rows

SCHEMA = "doc_id long, text string, lang string"


def brute(table, config):
    counts, sizes = Counter(), Counter()
    for text, lang in table:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, config.max_n + 1) for i in range(len(words) - n + 1))
    candidates = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= config.least:
            cuts = [(2 * config.unit * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
            candidates[lang, p] = (a, *min(cuts))
    out = []
    for lang in sizes:
        own = {p: v for (x, p), v in candidates.items() if x == lang}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        kept = [(p, v) for p, v in own.items() if not any(inside(p, q) and 100 * w[0] >= config.absorbed * v[0] for q, w in own.items())]
        kept.sort(key=lambda x: (-x[1][1], -x[1][0], " ".join(x[0]).encode()))
        out += [(lang, i, " ".join(p), a, l, r, sizes[lang], score) for i, (p, (a, score, _, l, r)) in enumerate(kept[: config.top], 1)]
    return sorted(out)


def planted(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Éa", "o'er", "X-1", "日本"]
    fixed = ["new york city hall", "New York", "a b a b a", "as well as", "per\tse  facto", "x x x x x"]
    table = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", "", ".", ", ", "\n", "\r\n"]) for _ in range(rng.randrange(60))]
        table.append((i, " ".join(parts), rng.choice(["en", "en", "de", None])))
    return table


@pytest.mark.parametrize("config", [phrases.PhraseConfig(least=5), phrases.PhraseConfig(least=3, max_n=3, top=7, absorbed=60), phrases.PhraseConfig(least=5, max_n=2)])
def test_equals_brute_force(spark, config):
    table = planted(1, 150)
    docs = spark.createDataFrame(table, SCHEMA).repartition(5)
    found = phrases.collocations(docs, config)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute([r[1:] for r in table], config)
    assert len(expected) > 10 and sorted(map(tuple, found.collect())) == expected


def test_awkward_rows(spark):
    config = phrases.PhraseConfig(least=2)
    assert sorted(map(tuple, phrases.collocations(documents(spark), config).collect())) == brute([r[1:3] for r in rows()], config)
    assert phrases.collocations(empty(spark), config).count() == 0


def test_scores_beyond_64_bits_and_ties(spark):
    big = 5 * 10**17
    counts = [("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 1, "c", big), ("en", 2, "a b", big - 3), ("en", 2, "b c", big - 3), ("en", 3, "a b c", 40)]
    found = {r["phrase"]: r for r in phrases.scored(spark.createDataFrame(counts, "lang string, n int, phrase string, f long"), phrases.PhraseConfig()).collect()}
    assert found["a b"]["score"] == 2_000_000 * (big - 3) // (2 * big - 1)
    three = found["a b c"]  # both cuts score 0 after flooring: the earliest counts
    assert (three["score"], three["l"], three["r"]) == (0, big, big - 3)


def test_words_longer_than_the_tables_and_bytes_alone(spark):
    """Words of over 48 bytes, characters of several bytes beside separators, and texts of separators alone."""
    long = "x" * 60
    table = [(i, f"{long}y {long}z\t{long}y {long}z É日,日É! É日 ... \x0b", "en") for i in range(6)] + [(9, " .\t. ", "de"), (10, "one", "")]
    config = phrases.PhraseConfig(least=3)
    docs = spark.createDataFrame(table, SCHEMA)
    assert sorted(map(tuple, phrases.collocations(docs, config).collect())) == brute([r[1:] for r in table], config)


def test_hashes_tell_orders_lengths_and_languages_apart():
    grams = phrases.Grams([b"a b b a ab a b", b"a b b a ab a b"], ["en", "de"])
    seen = {}
    for n in (1, 2, 3):
        at, k1, k2 = grams.phrases(n)
        for i, *key in zip(at.tolist(), k1.tolist(), k2.tolist()):
            seen.setdefault(tuple(key), set()).add((int(grams.text[i]), grams.spelled(i, n)))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == 2 * (3 + 5 + 5)
