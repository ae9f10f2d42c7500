"""Nested multi-hop contexts: normalisation of encodings, selection and assembly by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaflow.functions.strings import collapse, rstrip, strip, text


def bound(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once: what a lambda names but does not bind is evaluated again for each item."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def context_docs(c: Column, kind: T.DataType) -> Column:
    """array<struct<title, sentences>> from a struct of arrays, an array of (title, sentences) or of {title, sentences|sentence}.

    A single string in place of a sentence list counts as one sentence. Unequal array lengths are cut to the shorter.
    """

    def sentences(x: Column, t: T.DataType) -> Column:
        return F.coalesce(x, F.array().cast("array<string>")) if isinstance(t, T.ArrayType) else F.array(text(x))

    if isinstance(kind, T.StructType):
        name = "sentences" if "sentences" in kind.names else "sentence"
        inner = kind[name].dataType.elementType

        def zipped(title, body):
            n = F.least(F.size(title), F.size(body))
            docs = F.transform(
                F.slice(title, F.lit(1), n), lambda t, i: F.struct(text(t).alias("title"), sentences(F.get(body, i), inner).alias("sentences"))
            )
            return F.coalesce(F.when(n > 0, docs), _none())

        return bound(F.struct(c["title"].alias("title"), c[name].alias("body")), lambda x: zipped(x["title"], x["body"]))
    fields = kind.elementType.fields
    title_name, body_name = fields[0].name, fields[1].name
    docs = F.transform(c, lambda x: F.struct(text(x[title_name]).alias("title"), sentences(x[body_name], fields[1].dataType).alias("sentences")))
    return F.coalesce(docs, _none())


def _none() -> Column:
    return F.array().cast("array<struct<title:string,sentences:array<string>>>")


def supporting_pairs(c: Column, kind: T.DataType) -> Column:
    """array<struct<title, sent_id>> of a struct of arrays or an array of pairs; ids that are no integers are dropped."""
    if isinstance(kind, T.StructType):

        def zipped(title, ids):
            n = F.least(F.size(title), F.size(ids))
            pairs = F.transform(F.slice(title, F.lit(1), n), lambda t, i: F.struct(text(t).alias("title"), F.get(ids, i).try_cast("int").alias("sent_id")))
            return F.when(n > 0, pairs)

        pairs = bound(F.struct(c["title"].alias("title"), c["sent_id"].alias("ids")), lambda x: zipped(x["title"], x["ids"]))
    else:
        a, b = (f.name for f in kind.elementType.fields[:2])
        pairs = F.transform(c, lambda p: F.struct(text(p[a]).alias("title"), p[b].try_cast("int").alias("sent_id")))
    return F.coalesce(F.filter(pairs, lambda p: p["sent_id"].isNotNull()), F.array().cast("array<struct<title:string,sent_id:int>>"))


def supporting_titles(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda p: p["title"]))


def format_doc(doc: Column, collapse_ws: bool = True) -> Column:
    """title, newline, the non-blank sentences joined by spaces; '' where no text is left."""
    body = F.array_join(F.filter(F.transform(doc["sentences"], strip), lambda s: s != ""), " ")
    body = collapse(body) if collapse_ws else body
    return bound(body, lambda b: F.when(b == "", F.lit("")).otherwise(F.concat(doc["title"], F.lit("\n"), b)))


def format_passage(doc: Column) -> Column:
    return F.concat(doc["title"], F.lit(" | "), F.array_join(doc["sentences"], " "))


def gold_docs(docs: Column, titles: Column) -> Column:
    """Documents whose title is named; all of them where none is."""

    def chosen(docs, titles):
        named = F.filter(docs, lambda d: F.array_contains(titles, d["title"]))
        return bound(named, lambda x: F.when(F.size(x) > 0, x).otherwise(docs))

    return bound(docs, lambda d: bound(titles, lambda t: chosen(d, t)))


def supporting_docs(docs: Column, pairs: Column) -> Column:
    """Documents cut to their supporting sentences in sentence order; all documents where nothing is left."""

    def picked(d, pairs):
        ids = F.transform(F.filter(pairs, lambda p: p["title"] == d["title"]), lambda p: p["sent_id"])
        wanted = F.array_sort(F.array_distinct(F.filter(ids, lambda i: (i >= 0) & (i < F.size(d["sentences"])))))
        return F.struct(d["title"].alias("title"), F.transform(wanted, lambda i: F.get(d["sentences"], i)).alias("sentences"))

    def chosen(docs, pairs):
        kept = F.filter(F.transform(docs, lambda d: picked(d, pairs)), lambda d: F.size(d["sentences"]) > 0)
        return bound(kept, lambda x: F.when(F.size(x) > 0, x).otherwise(docs))

    return bound(docs, lambda d: bound(pairs, lambda p: chosen(d, p)))


def assemble(docs: Column, pairs: Column, mode: str = "all", cap: int = 0, collapse_ws: bool = True) -> Column:
    """The context text of a mode (all, gold_titles, supporting): blocks joined by a blank line, cut to ``cap`` characters."""
    chosen = {"all": lambda: docs, "gold_titles": lambda: gold_docs(docs, supporting_titles(pairs)), "supporting": lambda: supporting_docs(docs, pairs)}[mode]()
    blocks = F.filter(F.transform(chosen, lambda d: format_doc(d, collapse_ws)), lambda b: b != "")
    joined = strip(F.array_join(blocks, "\n\n"))
    return joined if cap <= 0 else bound(joined, lambda x: F.when(F.length(x) <= cap, x).otherwise(rstrip(F.substring(x, 1, cap))))


def select_passages(docs: Column, titles: Column, n: int, key: Column, seed: int) -> Column:
    """Passages for answer tuning: all gold ones (sampled where there are too many), filled with sampled others to ``n``, shuffled.

    Sampling and shuffling are orders by md5 of the row key, the seed, a step name and the title, so they do not depend on partitioning.
    """

    def order(docs_, step):
        tag = lambda d: F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(step), d["title"]).cast("binary"))
        tagged = lambda x: F.transform(x, lambda d, i: F.struct(tag(d).alias("o"), i.alias("i")))
        return bound(docs_, lambda held: F.transform(F.array_sort(tagged(held)), lambda x: F.get(held, x["i"])))

    if n <= 0:
        return F.transform(order(docs, "mix"), format_passage)

    def filled(docs, titles):
        gold = F.filter(docs, lambda d: F.array_contains(titles, d["title"]))
        others = F.filter(docs, lambda d: ~F.array_contains(titles, d["title"]))
        rest = lambda g: F.slice(order(others, "other"), F.lit(1), F.greatest(F.lit(n) - F.size(g), F.lit(0)))
        return bound(gold, lambda g: F.concat(F.slice(order(g, "gold"), 1, n), rest(g)))

    return F.transform(order(bound(docs, lambda d: bound(titles, lambda t: filled(d, t))), "mix"), format_passage)
