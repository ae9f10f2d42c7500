import re

from qaflow.llm import quality
from tests.llm.cases import documents, prose, rows


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark):
    extra = [(100 + i, prose(i, 30) + "\n" + prose(i % 3, 20) + "\n" + prose(i % 3, 20), "en", "a", 0, 0, "", 0.0) for i in range(20)]
    docs = documents(spark).union(spark.createDataFrame(extra, documents(spark).schema))
    texts = {r[0]: r[1] for r in rows() + extra if r[0] is not None}
    for r in quality.judge(docs).where("doc_id IS NOT NULL").collect():
        expected = brute(texts[r["doc_id"]])
        assert tuple(r[1:6]) == expected, r["doc_id"]
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r["base_failed"] and r["kept"])


def test_hash_bits_alone_never_count(spark, monkeypatch):
    # with nearly no hash bits left every window is a candidate, and the comparison of words decides
    monkeypatch.setattr(quality, "_POS_BITS", 62)
    text = prose(9, 200) + " " + prose(10, 30) + " x " + prose(10, 30)
    docs = spark.createDataFrame([(1, text, "en", "a")], "doc_id long, text string, lang string, source string")
    assert quality.measure(docs).first()["n_repeat_words"] == brute(text)[4]


def test_fences_follow_their_group(spark):
    good = [(i, prose(i, 100), "en", f"s{i % 2}") for i in range(80)]
    junk = [(1000, " ".join(w + "###" for w in prose(7, 100).split()), "en", "s0"), (1001, " ".join("longlonglonglongword%d" % i for i in range(100)), "en", "s1")]
    few = [(2000, prose(11, 100), "en", "rare")]
    docs = spark.createDataFrame(good + junk + few, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert not kept[1000] and not kept[1001] and kept[2000]
    assert all(kept[i] for i, *_ in good)
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {k for k, v in kept.items() if v}


def test_sketches_merge(spark):
    docs = spark.createDataFrame([(i, prose(i, 40 + i), "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    measured = quality.measure(docs)
    whole = {tuple(r) for r in quality.sketch(measured).collect()}
    halves = quality.sketch(measured.where("doc_id < 20")).union(quality.sketch(measured.where("doc_id >= 20")))
    merged = halves.groupBy("lang_key", "source_key", "metric", "bin").sum("n")
    assert {tuple(r) for r in merged.collect()} == whole


def test_only_repeats_reject(spark):
    """In a language whose documents have next to no repeated words, one with 15 % of them goes, though the base rule keeps it."""
    words = lambda seed, n: " ".join(f"{w}{i * 7919 % 9973}" for i, w in enumerate(prose(seed, n).split()))
    docs = [(i, words(i, 100), "en", "s") for i in range(2000)]
    body = words(5000, 100)
    again = " ".join(body.split()[:8])
    docs.append((9000, body + " x " + again, "en", "s"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality.judge(df).collect()}
    r = out[9000]
    assert r["n_repeat_words"] == 16 and not r["base_failed"] and not r["kept"]
    assert all(out[i]["kept"] for i in range(2000))
    # where more of the language's documents are like it, they are no outliers
    many = df.where("doc_id < 1000").union(df.where("doc_id = 9000").selectExpr("explode(sequence(20000, 20009)) AS doc_id", "text", "lang", "source"))
    assert all(r["kept"] for r in quality.judge(many).collect())
