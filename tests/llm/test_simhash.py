import random
import re

import numpy as np
import pytest
import xxhash

from qaflow.llm import simhash
from tests.llm.cases import prose


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def texts():
    out = [None, "", "A b", "a B", "ÀB c"]
    for k in range(12):
        words = prose(k, 400).split()
        out.append(" ".join(words))
        rng = random.Random(k)
        for _ in range(5):
            w = list(words)
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most", [4096, 4, 2])
def test_equals_brute_force(spark, most):
    """Also with buckets split by blocks of bits, and by blocks of rows."""
    data = list(enumerate(texts()))
    fps = {d: brute_fingerprint(t) for d, t in data}
    found = simhash.classes(spark.createDataFrame(data, "doc_id long, text string"), most=most).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in found} == fps
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_classes(fps)


def test_hot_fingerprints_are_joined_in_parts(spark):
    rows = [(i, "one text that very many rows hold") for i in range(300)] + [(300 + i, f"text {i} {i * i} {i * 7}") for i in range(50)] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = lambda hot: sorted((str(r["doc_id"]), r["text_key"], r["fp"], r["component_id"]) for r in simhash.classes(df, hot=hot).collect())
    assert found(7) == found(1 << 20) and len(found(7)) == len(rows)


def test_masks_cover_the_radius():
    masks = simhash.covering_masks()
    rng = random.Random(1)
    assert len(masks) == 31
    for _ in range(3000):
        difference = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        hit = [m for m in masks if not m & difference]
        assert hit
        assert any(not b & difference for b in simhash.free_blocks(hit[0]))


def test_forest_keeps_components():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = list({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(40)})
    signed = np.array([simhash._signed(x) for x in fps], np.int64)
    edges = simhash.forest(signed)
    expected = brute_classes(dict(enumerate(fps)))
    at = {int(s): i for i, s in enumerate(signed)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert {i: find(i) for i in range(len(fps))} == expected
    assert len(edges) == len(fps) - len(set(expected.values()))


def test_keep_one(spark):
    same, other = prose(20, 300), prose(21, 300)
    data = [(5, same), (3, same), (3, same), (3, other), (9, other), (None, same), (7, prose(22, 300))]
    kept = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(3, same), (3, other), (7, prose(22, 300))])
