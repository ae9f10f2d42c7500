import random

import numpy as np
import pyarrow as pa
import pytest

from qaflow.llm import paragraphs as P

CONFIG = P.ParagraphConfig()


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_bands_reach_the_recall():
    for rows in (2, 3, 4):
        b = P.bands_for(0.8, rows, 0.99)
        assert 1 - (1 - 0.8**rows) ** b >= 0.99 > 1 - (1 - 0.8**rows) ** (b - 1)


def test_every_passage_of_51_words_shares_a_block():
    rng = random.Random(1)
    for _ in range(300):
        passage = prose(rng, 51)
        texts = [" ".join(prose(rng, rng.randint(0, 80)) + passage + prose(rng, rng.randint(0, 80))) for _ in range(2)]
        a, b = (P.Cut(t.encode(), CONFIG) for t in texts)
        assert set(a.ids().tolist()) & set(b.ids().tolist())


def keys_of(cut):
    """A set of band keys for each paragraph; equal words are the only key of a block."""
    found = [{x} for x in cut.ids().tolist()]
    for number, keys in zip(cut.band_keys(CONFIG)[0].tolist(), cut.band_keys(CONFIG)[1].T.tolist()):
        found[number] |= set(keys)
    return found


def test_edited_passage_inside_lines_is_found():
    """Copies of 100 words with one word of them changed, in other text: a run of both is similar enough and meets in a band."""
    rng = random.Random(7)
    met = 0
    for _ in range(100):
        passage = prose(rng, 100)
        other = passage[:50] + ["edited"] + passage[51:]
        a, b = (P.Cut(" ".join(prose(rng, 60) + w + prose(rng, 60)).encode(), CONFIG) for w in (passage, other))
        sets = [[set(c.shingles[i : j - CONFIG.shingle + 1].tolist()) for i, j in zip(c.first, c.last)] for c in (a, b)]
        ka, kb = keys_of(a), keys_of(b)
        ids = [c.ids().tolist() for c in (a, b)]
        met += any(
            ids[0][i] != ids[1][j] and exact(sets[0][i], sets[1][j]) >= 0.8 and ka[i] & kb[j]
            and a.first[i] < 110 <= a.last[i] - 1
            for i in range(1, len(ka)) for j in range(1, len(kb))
        )
    assert met >= 70


@pytest.mark.parametrize("kind,words", [("line", 25), ("line", 200), ("run", 50)])
@pytest.mark.parametrize("level", [0.8, 0.9])
def test_recall_of_each_kind(kind, words, level):
    """Pairs by brute force with a similarity from the level up to 0.1 more: at least 0.9 of them meet in a band."""
    rng = random.Random(words * 10 + int(level * 10))
    met = tried = 0
    while tried < 200:
        base = prose(rng, words)
        other = list(base)
        for _ in range(rng.randint(1, max(1, words // 40))):
            other[rng.choice([0, 1, len(other) - 1, rng.randrange(len(other))])] = "edit%d" % rng.randrange(10_000)
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other)]
        if not level <= exact(*sets) < level + 0.1:
            continue
        tried += 1
        cuts = [P.Cut(" ".join(w).encode(), CONFIG) for w in (base, other)]
        for c in cuts:  # one paragraph of all words, and of this kind
            c.first, c.last, c.blocks = np.zeros(1, np.int64), np.array([words]), 0
            c.lines = int(kind == "line")
        met += bool(keys_of(cuts[0])[0] & keys_of(cuts[1])[0])
    assert met >= 0.9 * tried


def test_equal_blocks_are_always_found(spark):
    """Recall of blocks: every block that two texts share, by brute force over their words, is in a listed passage."""
    rng = random.Random(12)
    passage = prose(rng, 51)
    docs = [(i, " ".join(prose(rng, rng.randint(30, 90)) + passage + prose(rng, 40))) for i in range(8)]
    found = P.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for i, text in docs:
        at = text.index(" ".join(passage))
        assert any(r["doc_id"] == i and r["start"] < at + 200 and r["end"] > at for r in found)
        if i:
            gone = set().union(*[range(r["start"], r["end"]) for r in found if r["doc_id"] == i and r["removed"]])
            assert all(k in gone or text[k] == " " for k in range(at, at + len(" ".join(passage))))


def test_collisions_leave_out_overlaps_of_one_text(spark):
    span = lambda a, b: a << 32 | b
    rows = [
        (1, 10, 5, span(0, 90)), (1, 11, 5, span(40, 130)),  # overlap in one text
        (2, 10, 5, span(0, 90)), (2, 11, 5, span(95, 130)),  # apart in one text
        (3, 10, 5, span(0, 90)), (3, 11, 6, span(0, 90)),  # two texts
        (4, 10, 5, span(0, 90)), (4, 10, 6, span(7, 97)), (4, 11, 5, span(40, 130)), (4, 11, 6, span(47, 137)),  # copies
        (5, 10, 5, span(0, 90)), (5, 10, 7, span(0, 90)),  # one paragraph
        (6, 10, 5, span(0, 90)), (6, 10, 6, span(0, 90)), (6, 11, 5, span(40, 130)),  # in two texts, and in one of them
    ]
    df = spark.createDataFrame(rows, "key long, uid long, version long, span long")
    found = sorted(tuple(r) for r in P.collisions(df).collect())
    assert found == [(k, u) for k in (2, 3, 6) for u in (10, 11)]


def whole_buckets(rows):
    """The definition, bucket by bucket: of each paragraph its first and last version count."""
    out, by_key = [], {}
    for key, uid, version, span in sorted(rows):
        by_key.setdefault(key, {}).setdefault(uid, []).append((version, span))
    for key, uids in by_key.items():
        alone = True
        for at in (0, -1):
            picked = [v[at] for v in uids.values()]
            alone &= len({v for v, _ in picked}) == 1 and max(x >> 32 for _, x in picked) < min(x & (1 << 32) - 1 for _, x in picked)
        if len(uids) > 1 and not alone:
            out += [(key, u) for u in uids]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_collisions_for_any_batches(spark, size):
    rng = random.Random(size)
    rows = []
    for _ in range(400):
        start = rng.randrange(60)
        rows.append((rng.randrange(40), rng.randrange(4), rng.randrange(3), start << 32 | start + rng.choice([20, 45, 80])))
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "key long, uid long, version long, span long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        assert sorted(tuple(r) for r in P.collisions(df).collect()) == whole_buckets(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_bucket_is_not_gathered(spark):
    """One key of a million different paragraphs: what the task allocates in Python stays within some batches."""
    import tracemalloc

    rows = spark.range(0, 1_000_000, 1, 4).selectExpr("5L AS key", "id AS uid", "id % 1000 AS version", "shiftleft(id % 77, 32) + id % 77 + 300 AS span")
    plan = P.collisions(rows)
    assert plan.count() == 1_000_000 and plan.distinct().count() == 1_000_000
    # the task's function on the same rows, in this process
    caught = {}
    original = type(rows).mapInArrow
    type(rows).mapInArrow = lambda self, f, *a, **k: caught.update(f=f) or original(self, f, *a, **k)
    try:
        P.collisions(rows)
    finally:
        type(rows).mapInArrow = original

    def batches():
        for i in range(100):
            uid = np.arange(i * 10_000, (i + 1) * 10_000)
            cells = [np.full(10_000, 5), uid, uid % 1000, (uid % 77 << 32) + uid % 77 + 300]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["key", "uid", "version", "span"])

    tracemalloc.start()
    assert sum(b.num_rows for b in caught["f"](batches())) == 1_000_000
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_short_lines_in_a_row_are_one_paragraph():
    rng = random.Random(8)
    long = prose(rng, 40)
    short = [prose(rng, 9) for _ in range(3)]
    text = "\n".join(" ".join(x) for x in [long, *short, long, prose(rng, 7)])
    cut = P.Cut(text.encode(), CONFIG)
    natural = list(zip(cut.first[: cut.lines].tolist(), cut.last[: cut.lines].tolist()))
    assert natural == [(0, 40), (40, 67), (67, 107)]
    each = P.Cut(text.encode(), P.ParagraphConfig(line=5))
    assert each.lines == 6
    assert P.Cut(b"just six words in one text", CONFIG).lines == 1 and not len(P.Cut(b"no shingle here", CONFIG).first)


def test_short_lines_that_repeat(spark):
    rng = random.Random(10)
    docs = [(i, " ".join(prose(rng, 60)) + "\nthe same nine words at the end of it\n" + " ".join(prose(rng, 60))) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert P.repeated(df).count() == 0
    cleaned = P.remove(df, P.ParagraphConfig(line=5)).collect()
    assert {r["doc_id"] for r in cleaned if "nine words" in r["text"]} == {0}
    assert all(len(r["text"].split()) == 120 for r in cleaned if r["doc_id"])


def test_texts_that_share_a_doc_id(spark):
    rng = random.Random(11)
    passage, own = prose(rng, 80), [prose(rng, 90) for _ in range(3)]
    docs = [(3, " ".join(own[0] + passage)), (5, " ".join(own[1][:30] + passage + own[1][30:])), (5, " ".join(own[2])), (5, " ".join(own[2]))]
    cleaned = sorted((r["doc_id"], r["text"]) for r in P.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert cleaned == sorted([(3, docs[0][1]), (5, cleaned_text(docs[1][1], passage)), (5, docs[2][1]), (5, docs[2][1])])


def cleaned_text(text, passage):
    before, after = text.split(" ".join(passage))
    return before + after


def test_positions_are_code_points():
    rng = random.Random(2)
    text = "é" + " ß ".join(prose(rng, 80)) + "\n日本 " + "  ".join(prose(rng, 40))
    cut = P.Cut(text.encode(), CONFIG)
    words = text.split()
    assert cut.lines == 2
    for span, i, j in zip(cut.spans().tolist(), cut.first, cut.last):
        assert text[span >> 32 : span & 0xFFFFFFFF].split() == words[i:j]


def exact(a, b):
    return len(a & b) / len(a | b)


def test_links_equal_exact_similarity(spark):
    """Lines with edits: all pairs at 0.8 or more must be linked, and no others (by closure)."""
    rng = random.Random(3)
    docs, lines = [], []
    for k in range(25):
        base = prose(rng, 70)
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 6])):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
            lines.append(w)
    rng.shuffle(lines)
    docs = [(i, " ".join(prose(rng, 5)) + "\n" + " ".join(w)) for i, w in enumerate(lines)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if exact(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    found = P.repeated(spark.createDataFrame(docs, "doc_id long, text string"), CONFIG).collect()
    start = {d: t.index("\n") + 1 for d, t in docs}
    mine = {}
    for r in found:
        if r["removed"] and r["start"] <= start[r["doc_id"]] and r["end"] == len(dict(docs)[r["doc_id"]]):
            mine.setdefault(r["doc_id"], set()).add(r["first_doc_id"])
    expected = {i: find(i) for i in range(len(lines)) if find(i) != i}
    missing = {i for i in expected if expected[i] not in mine.get(i, ())}
    assert set(mine) <= set(expected) and len(missing) <= 2  # bands may miss a pair at the threshold


def test_pairs_counted_together():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2)
    first = [np.unique(base[i % 7 : 50]) for i in range(90)] + [base[:1]]
    second = [np.unique(base[: 42 + i % 18]) for i in range(90)] + [base[1:2]]
    expected = [exact(set(a.tolist()), set(b.tolist())) >= 0.8 for a, b in zip(first, second)]
    assert P.similar_pairs(first, second, 0.8).tolist() == expected and 0 < sum(expected) < 90
    buckets = [(list(range(10 * i, 10 * i + 4)), [first[i], second[i], first[i + 1], second[i + 1]]) for i in range(0, 88, 2)]
    edges = P.bucket_edges(buckets, 0.8)
    for ids, sets in buckets:
        mine = {frozenset(e) for e in edges if e[0] in ids}
        forest = {frozenset(e) for e in P.jaccard_forest(ids, sets, 0.8)}
        assert all(reach(mine, x) == reach(forest, x) for x in ids)
        assert len(mine) < len(ids)


def reach(edges, x):
    found = {x}
    while more := {y for e in edges if e & found for y in e} - found:
        found |= more
    return found


@pytest.mark.parametrize("most", [1024, 4, -1024])
def test_blocks_of_a_bucket_lose_no_link(spark, most):
    rng = random.Random(4)
    base = [int(x) for x in np.random.default_rng(4).integers(0, 1 << 60, 40)]
    sets = {}
    for uid in range(30):
        s = set(base)
        for _ in range(rng.randint(0, 2)):
            s.discard(rng.choice(base))
            s.add(rng.randrange(1 << 60))
        sets[uid] = np.array(sorted(s), np.uint64)
    collided = spark.createDataFrame([(7, u) for u in sets], "key long, uid long")
    shingles = spark.createDataFrame([(u, len(s), bytearray(s.tobytes())) for u, s in sets.items()], "uid long, size long, shingles binary")
    config = P.ParagraphConfig(most=abs(most), most_shingles=1 << 20 if most > 0 else 200)
    edges = {(r["a"], r["b"]) for r in P.verified_links(collided, shingles, config).collect()}
    root = list(range(30))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    expected = list(range(30))

    def up(x):
        while expected[x] != x:
            x = expected[x]
        return x

    for i in range(30):
        for j in range(i):
            if exact(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8:
                expected[max(up(i), up(j))] = min(up(i), up(j))
    assert [find(i) for i in range(30)] == [up(i) for i in range(30)]


def test_planted_passages_and_clean_documents(spark):
    rng = random.Random(5)
    passage = " ".join(prose(rng, 55))
    docs = [(i, " ".join(prose(rng, 120))) for i in range(40)]
    for i in (3, 11, 29):
        w = docs[i][1].split()
        at = rng.randrange(len(w))
        docs[i] = (i, " ".join(w[:at] + [passage] + w[at:]))
    docs.append((50, docs[20][1] + "\n" + docs[20][1]))  # repeats document 20, and itself
    within = " ".join(prose(rng, 60))
    docs.append((60, within + "\n" + within))  # repeats only within itself
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = P.repeated(df).collect()
    assert {r["doc_id"] for r in found} == {3, 11, 29, 20, 50}
    assert all(r["removed"] == (r["doc_id"] != r["first_doc_id"]) or r["doc_id"] == 50 for r in found if r["doc_id"] != 20)
    cleaned = {r["doc_id"]: r["text"] for r in P.remove(df).collect()}
    texts = dict(docs)
    assert all(cleaned[i] == texts[i] for i in texts if i not in (11, 29, 50))
    assert len(cleaned[11].split()) <= 175 - 20 and len(cleaned[11]) < len(texts[11]) and len(cleaned[50]) < len(texts[50])


def test_the_whole_passage_is_removed(spark):
    rng = random.Random(9)
    docs, own = [], {}
    passage = {60: prose(rng, 60), 150: prose(rng, 150)}
    for i in range(12):
        own[i] = prose(rng, 100)
        at = rng.randrange(1, 100)
        docs.append((i, " ".join(own[i][:at] + passage[(60, 150)[i % 2]] + own[i][at:])))
    cleaned = {r["doc_id"]: r["text"].split() for r in P.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(len(cleaned[i]) == 100 + (60, 150)[i] for i in (0, 1))
    assert all(len(own[i]) - 12 <= len(cleaned[i]) <= len(own[i]) for i in range(2, 12))


def test_texts_cut_together_are_cut_as_each():
    rng = random.Random(8)
    bits = ["a ", "bé ", "\n", "\r\n", "w x y z v u ", "longer\t", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(250))).encode() for _ in range(300)] + [b"", b"\n", b"a", b""]
    many, at = P.Cuts(texts, CONFIG), 0
    keys = many.band_keys(CONFIG)[1]
    for i, text in enumerate(texts):
        each = P.Cut(text, CONFIG)
        n = len(each.first)
        own = many.text == i
        assert own.sum() == n
        if n:
            assert (many.ids()[own] == each.ids()).all() and (many.spans()[own] == each.spans()).all()
            number, wanted = each.band_keys(CONFIG)
            assert (keys[:, at : at + len(number)] == wanted).all()
            at += len(number)
    assert at == keys.shape[1] and not len(P.Cuts([b"", b""], CONFIG).first)
