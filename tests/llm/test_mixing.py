import hashlib
import math
from collections import Counter

from qaflow.llm import mixing


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def count(doc, rate, seed):
    parts = max(1, math.ceil(rate / mixing.PART))
    mean, total = rate / parts, 0
    for part in range(1, parts + 1):
        u, k, below = unit(doc, seed, part), 0, math.exp(-mean)
        while below <= u and k < 47:
            k += 1
            below += math.exp(-mean) * mean**k / math.factorial(k)
        total += k + (below <= u)
    return total


def frame(spark, n=3000):
    rows = [(i, f"t{i}", "big" if i % 3 else ("small" if i % 300 else "rare")) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_counts_equal_inverted_distribution(spark):
    config = mixing.MixConfig(weights={"big": 1, "small": 1, "rare": 1}, size=1.0)
    rates = {r["source_key"]: r["rate"] for r in mixing.rates(frame(spark), config).collect()}
    assert rates["=rare"] > 50  # many parts
    out = Counter(r["doc_id"] for r in mixing.mix(frame(spark), config).collect())
    for r in frame(spark).collect():
        assert out.get(r["doc_id"], 0) == count(r["doc_id"], rates["=" + r["source"]], config.seed), r


def test_shares_follow_the_weights(spark):
    out = Counter(r["source"] for r in mixing.mix(frame(spark), mixing.MixConfig(weights={"big": 1, "small": 2, "rare": 1}, other=0.0)).collect())
    n = sum(out.values())
    assert abs(n - 3000) < 300 and abs(out["small"] / n - 0.5) < 0.05 and abs(out["rare"] / n - 0.25) < 0.05


def test_same_for_any_partitioning_and_globally_ordered(spark):
    rows = lambda df: sorted(tuple(r) for r in mixing.mix(df).collect())
    assert rows(frame(spark).repartition(1)) == rows(frame(spark).repartition(7))
    order = [r["mix_order"] for r in mixing.mix(frame(spark)).collect()]
    assert order == sorted(order)


def test_equal_orders_go_by_document(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "unit_hash", lambda *parts: F.lit(0.25))
    out = [(r["doc_id"], r["copy_no"]) for r in mixing.mix(frame(spark, 30).repartition(5)).collect()]
    assert out == sorted(out, key=lambda x: (str(x[0]), x[1])) and out


def test_zero_weight_and_zero_total(spark):
    assert {r["source"] for r in mixing.mix(frame(spark), mixing.MixConfig(weights={"rare": 1}, other=0.0)).collect()} == {"rare"}
    assert mixing.mix(frame(spark), mixing.MixConfig(weights={"none": 1}, other=0.0)).count() == 0
