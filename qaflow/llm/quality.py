"""Quality rules with thresholds that follow the data: a quantile sketch for each language and source.

Native: only Spark SQL expressions. Per document, one pass over its word array gives the counts; the
sketch is a log-linear histogram (the top five significant bits of a value are kept, so a bin is at
most 1/16 wide relative to its value). Its counts add, so sketches merge from (language, source) to
language to all documents, and the result is the same for any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.llm.common import join_small, let, materialize, unpacked

WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
_POS_BITS = 28


@dataclass(frozen=True)
class QualityRules:
    """Parameters: fences lie ``reach`` spreads outside the quartiles of a group.

    The spread of a group is its interquartile range, at least ``least_spread`` of the metric. Most documents have no
    repeats at all, so quartiles say little of ``tails`` metrics: their fences lie no nearer than the quantile ``tail`` (per
    mille) of the language, and reject that share of it at most. Since means of few words vary more, the fences of a document
    of n words lie (n + ``short_words``) / n times as far. A group with fewer than ``min_docs`` documents uses its
    language's sketch, or that of all documents.
    """

    reach: int = 4
    min_docs: int = 30
    short_words: int = 20
    #: metric: (least spread, has a lower fence). Word length is in hundredths, the rest are per mille.
    metrics: tuple = (("word_len", 40, True), ("symbols", 30, False), ("dup_lines", 25, False), ("repeats", 10, False))
    tails: tuple = ("dup_lines", "repeats")
    tail: int = 999


def _neighbours_equal(sorted_items: Column, key) -> Column:
    """Items of a sorted array whose key equals that of the item before or after."""
    return F.filter(
        sorted_items,
        lambda x, i: F.coalesce(key(x) == key(F.get(sorted_items, i - 1)), F.lit(False))
        | F.coalesce(key(x) == key(F.get(sorted_items, i + 1)), F.lit(False)),
    )


def _covered(positions: Column, width: int) -> Column:
    """Words covered by windows of ``width`` that begin at the sorted positions."""
    steps = F.transform(positions, lambda p, i: F.least(F.lit(width).cast("long"), F.get(positions, i + 1) - p))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a ``width``-word window found twice or more in the array.

    Windows are packed as 36 hash bits and the position into longs and sorted; windows that share the
    bits with a neighbour are then compared by their words, so the count is exact.
    """

    def window_words(w, p):
        return F.concat_ws(" ", *[F.get(w, p.cast("int") + k) for k in range(width)])

    def exact(w, candidates):
        positions = F.transform(candidates, lambda x: x.bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        pairs = F.sort_array(F.transform(positions, lambda p: F.struct(window_words(w, p).alias("s"), p.alias("p"))))
        return let(
            pairs,
            lambda s: let(
                F.sort_array(F.transform(_neighbours_equal(s, lambda x: x["s"]), lambda x: x["p"])), lambda ps: _covered(ps, width)
            ),
        )

    def of(w):
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        keys = let(
            hashes,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(h) - width),
                lambda i: F.shiftleft(F.xxhash64(*[F.get(h, i + k) for k in range(width)]), _POS_BITS).bitwiseOR(i.cast("long")),
            ),
        )
        found = let(F.sort_array(keys), lambda k: _neighbours_equal(k, lambda x: F.shiftright(x, _POS_BITS)))
        counted = let(found, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(exact(w, c)))
        return F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(counted)

    return let(words, of)


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")


def measure(docs: DataFrame, packed: bool = False) -> DataFrame:
    """Counts per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    One row per input row with doc_id, lang and source kept as they are; other columns are not read.
    Null text counts as empty. The text itself is not carried on, unless ``packed`` asks for the whole row as a struct ``row``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP), "")
    full = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    counts = F.struct(
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(
            full,
            lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
        ).alias("l"),
    )
    whole = [F.struct("*").alias("row")] if packed else []
    rows = docs.select("doc_id", "lang", "source", _text_key(), counts.alias("c"), *whole)
    out = rows.select(
        *["row"][: len(whole)],
        "doc_id",
        "lang",
        "source",
        "text_key",
        F.col("c.w.n_words").alias("n_words"),
        F.col("c.w.word_chars").alias("word_chars"),
        F.col("c.n_symbols").alias("n_symbols"),
        F.col("c.l.dup").alias("n_dup_lines"),
        F.col("c.w.n_repeat_words").alias("n_repeat_words"),
        F.col("c.l.n").alias("n_lines"),
    )
    return out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


#: Integer metrics of a measured document.
METRIC_SQL = {
    "word_len": "100 * word_chars div greatest(n_words, 1)",
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
}


def _bin(value: Column) -> Column:
    """Lower end of the value's bin: all but the top five significant bits are cleared."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _keys() -> list[Column]:
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return [tag("lang").alias("lang_key"), tag("source").alias("source_key")]


def sketch(measured: DataFrame) -> DataFrame:
    """Mergeable quantile sketch: (lang_key, source_key, metric, bin, n) over documents that pass the base rules."""
    values = F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(v).cast("long").alias("v")) for k, v in METRIC_SQL.items()])
    rows = measured.where("NOT base_failed").select(*_keys(), F.explode(values).alias("x"))
    return rows.groupBy("lang_key", "source_key", F.col("x.metric").alias("metric"), _bin(F.col("x.v")).alias("bin")).agg(
        F.count("*").alias("n")
    )


def _quartiles(sketches: DataFrame, keys: list[str], tail: int) -> DataFrame:
    """Merge sketches to ``keys`` and read quantiles: the least bin that covers a quarter, or three, of the rows, and the end of that which covers ``tail`` per mille."""
    merged = sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    bins = merged.groupBy(*keys).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def at(share: int, of: int) -> Column:
        step = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("long").alias("q")),
            lambda acc, x: F.struct(
                (acc["cum"] + x["n"]).alias("cum"),
                F.coalesce(acc["q"], F.when((acc["cum"] + x["n"]) * of >= F.col("total") * share, x["bin"])).alias("q"),
            ),
        )
        return step["q"]

    last = at(tail, 1000)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(last)) - 5, F.lit(0)))
    return bins.select(*keys, "total", at(1, 4).alias("q1"), at(3, 4).alias("q3"), (last + width - 1).alias("top"))


def fences(sketches: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Quartiles and spread of each metric for each (lang_key, source_key), from the narrowest sketch that is large enough."""
    own = _quartiles(sketches, ["lang_key", "source_key", "metric"], rules.tail)
    lang = _quartiles(sketches, ["lang_key", "metric"], rules.tail)
    every = _quartiles(sketches, ["metric"], rules.tail)
    named = lambda df, p: df.select(*[F.col(c).alias(c if c.endswith("key") or c == "metric" else f"{p}_{c}") for c in df.columns])
    all_ = named(own, "o").join(named(lang, "l"), ["lang_key", "metric"]).join(named(every, "e"), "metric")
    pick = lambda c: F.when(F.col("o_total") >= rules.min_docs, F.col(f"o_{c}")).when(F.col("l_total") >= rules.min_docs, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}"))
    top = F.when(F.col("l_total") >= rules.min_docs, F.col("l_top")).otherwise(F.col("e_top"))
    q = all_.select("lang_key", "source_key", "metric", pick("q1").alias("q1"), pick("q3").alias("q3"), top.alias("top"))
    out = []
    for name, least, _ in rules.metrics:
        mine = F.col("metric") == name
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * rules.reach
        spread = F.greatest(spread, F.col("top") - F.col("q3")) if name in rules.tails else spread
        out += [F.max(F.when(mine, c)).alias(f"{k}_{name}") for k, c in (("q1", F.col("q1")), ("q3", F.col("q3")), ("spread", spread))]
    return q.groupBy("lang_key", "source_key").agg(*out)


def _verdict(rules: QualityRules) -> Column:
    ok = F.lit(True)
    width = F.col("n_words") + rules.short_words
    for name, _, lower in rules.metrics:
        value, spread = F.expr(METRIC_SQL[name]), F.col(f"spread_{name}") * width
        ok = ok & F.coalesce((value - F.col(f"q3_{name}")) * F.col("n_words") <= spread, F.lit(True))
        if lower:
            ok = ok & F.coalesce((F.col(f"q1_{name}") - value) * F.col("n_words") <= spread, F.lit(True))
    return ~F.col("base_failed") & ok


def _with_verdict(measured: DataFrame, rules: QualityRules) -> DataFrame:
    """The written rows of ``measured`` with ``kept``: sketches come from them, and the small table of fences is joined to them."""
    limits = materialize(fences(materialize(sketch(measured), "sketch"), rules), "fences")
    rows = measured.select("*", *_keys())
    return join_small(rows, limits, ["lang_key", "source_key"], F.col("text_key"), "left").withColumn("kept", _verdict(rules))


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and every metric lies within its group's fences.
    Null text counts as empty (so it fails the base rules); null lang or source forms a group of its
    own. Texts of any length are measured whole. An empty table gives an empty result; repeated rows are judged one by one; columns besides
    doc_id, text, lang and source are ignored.
    """
    return _with_verdict(materialize(measure(docs), "quality"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows are written once beside their counts, so that texts are counted once and never shuffled; each row's verdict is
    its own, also among repeated ones. Nulls and clashing names are handled as in ``judge``.
    """
    counted = materialize(measure(docs, packed=True), "quality-rows")
    return unpacked(_with_verdict(counted, rules).where("kept"), docs.columns)
