import random
import sys
import unicodedata

from pyspark.sql import functions as F

from qaflow.functions.unicode import nfd


def test_every_code_point(spark):
    rows = [(chr(c),) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    found = spark.createDataFrame(rows, "t string").repartition(4).select("t", nfd(F.col("t")).alias("n")).collect()
    assert len(found) == len(rows)
    assert [r["t"] for r in found if r["n"] != unicodedata.normalize("NFD", r["t"])] == []


def test_random_sequences_of_marks(spark):
    rng = random.Random(1)
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    singles = [chr(c) for c in range(0x3000) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    texts = [None, "", "plain", "ạ́", "̣́", "q̣̇\ṇ́", "ṩ", "각̣́"]
    for _ in range(3000):
        pool = [rng.choice(marks), rng.choice(marks), rng.choice(marks), rng.choice(singles), rng.choice("ab \n각가힣"), "́", "̣"]
        texts.append("".join(rng.choice(pool) for _ in range(rng.randrange(12))))
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", nfd(F.col("t")).alias("n")).collect()
    assert [texts[r["i"]] for r in found if r["n"] != (None if texts[r["i"]] is None else unicodedata.normalize("NFD", texts[r["i"]]))] == []


def test_long_text(spark):
    text = "Été à l'œuvre, naïve 각 " * 20_000
    assert spark.createDataFrame([(text,)], "t string").select(nfd(F.col("t"))).first()[0] == unicodedata.normalize("NFD", text)
