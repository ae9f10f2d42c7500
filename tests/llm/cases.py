"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the of and tion ing ther ation ness ment able over under water stone light river green quiet".split()


def prose(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(WORDS[:8]))
        if rng.random() < 0.1:
            out[-1] += "."
        if rng.random() < 0.03:
            out[-1] += "\n"
    return " ".join(out)


def rows():
    """(doc_id, text, lang, source, n_chars, row, fp, u): the last three clash with names used inside."""
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "one two three",
        prose(1, 60),
        prose(1, 60),
        prose(2, 40),
        prose(3, 4000),
        "word " * 300,
        "# $ % & | < > * " * 20,
        "é ñ ß 日本語 😀 á \x1c\x85\xa0 end",
        "Write to ann.lee@mail.example.com or +1 (415) 555-2665; later 415-555-2665.",
        prose(4, 80) + "\n" + prose(5, 70) + "\n" + prose(4, 80),
        "x" * 30_000,
    ]
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "a", None, "b"][i % 4], None if t is None else len(t), i, "fp", 0.5) for i, t in enumerate(texts)]
    out.append(out[5])  # a repeated row
    out.append((None, prose(6, 50), "en", "a", 1, 0, "x", 0.1))
    out.append((None, None, None, None, None, None, None, None))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, fp string, u double"


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
