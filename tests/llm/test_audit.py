import itertools
import random
import re

from qaflow.llm import audit
from tests.llm.cases import documents, empty, prose, rows

LABELS = "doc_id long, quality int, toxic int"
NAMES = "ABCDE"


def brute(table, labels):
    """Every order applied to the documents one filter at a time."""
    flags = []
    for doc_id, text, lang in table:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in table),
        }
        good = any(d == doc_id and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == doc_id and x == 1 for d, _, x in labels if d is not None)
        flags.append((lang or "", {k for k in NAMES if failed[k]}, good, toxic))
    out = []
    for part in {f[0] for f in flags}:
        own, shares = [f for f in flags if f[0] == part], dict.fromkeys(NAMES, 0)
        lines = []
        for order in itertools.permutations(NAMES):
            left = own
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                shares[name] += len(gone)
                failing = sum(name in f[1] for f in own)
                lines.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f[1] == {name} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone), name])
        out += [tuple(x[:-1] + [shares[x[-1]]]) for x in lines]
    return sorted(out)


def test_awkward_rows_equal_brute_force(spark):
    labels = [(3, 1, 0), (5, 1, 1), (5, 0, 0), (6, 0, 1), (None, 1, 1), (9, None, None), (99, 1, 1), (14, 1, None)]
    found = audit.audit(documents(spark), spark.createDataFrame(labels, LABELS))
    assert found.columns == [c.split()[0] for c in audit.COLUMNS.split(", ")]
    assert sorted(map(tuple, found.collect())) == brute([r[:3] for r in rows()], labels)


def test_copies_and_long_texts_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [prose(i, n) for i, n in enumerate((250, 260, 30, 300))] + ["Ab " * 300, prose(9, 50_000), "# " + prose(8, 210), None, ""]
    table = [(i, rng.choice(pool), rng.choice(["en", "", None])) for i in range(200)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 200, 2)]
    docs = spark.createDataFrame(table, "doc_id int, text string, lang string").repartition(5)
    assert sorted(map(tuple, audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect())) == brute(table, labels)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit.audit(empty(spark), labels).count() == 0
    found = audit.audit(documents(spark), labels)
    assert found.count() == 600 * 3 and found.where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_polynomial_of_other_numbers_of_filters():
    rng = random.Random(6)
    for k in (1, 2, 3, 4, 6):
        counts = [rng.randrange(50) for _ in range(1 << k)]
        polynomial = audit.removal_polynomial(counts)
        values = audit.corners(polynomial)
        assert values == [sum(n for m, n in enumerate(counts) if m & s) for s in range(1 << k)]
        shares = [audit.shapley_value(polynomial, i) for i in range(k)]
        assert sum(shares) == values[-1]
        for i in range(k):
            orders = list(itertools.permutations(range(k)))
            gains = [values[(before := sum(1 << j for j in o[: o.index(i)])) | 1 << i] - values[before] for o in orders]
            assert shares[i] * len(orders) == sum(gains)
