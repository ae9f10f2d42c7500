"""Grounded-QA jobs from a corpus: validity, fan-out, mismatched contexts, quote grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.functions.strings import NO_CONTEXT, strip, truncate_chars
from qaflow.operators.sampling import exact_rank, hash01, hash_int, range_bucket, seeded

CORPUS_IDK = "I can't find the answer in the context"


def valid_rows(df: DataFrame, lang: str = "en", min_context: int = 300, max_context: int = 6000, max_query: int = 512) -> DataFrame:
    """Rows of ``lang`` (a bare comparison, so that it reaches the scan) with a query and a context of fitting lengths."""
    query, context = strip(F.col("query")), strip(F.col("query_seed_text"))
    return df.where(
        (F.col("language") == lang)
        & (query != "")
        & (F.length(query) <= max_query)
        & (F.length(context) >= max(min_context, 1))
        & (F.length(context) <= max_context * 10)
    )


def ordered(df: DataFrame, key: str, name: str = "rn") -> DataFrame:
    """Row numbers in the order of a numeric key."""
    return exact_rank(df, [F.col(key)], range_bucket(df, key), (), name)


def mismatched(df: DataFrame, key: str, url: str, context: str, pool: int = 4096, warm: int = 256, p: float = 1.0, seed: int = 11, tries: int = 10) -> DataFrame:
    """Pair a row with the context of an earlier one: of ``tries`` + 1 hashed picks among the last ``pool`` rows the first with another URL, else the last.

    Rows within the first ``warm`` have no partner; a row draws one with probability ``p``. Each pick is a
    row number, so partners come from an equi-join, and nothing is compared pairwise.
    """
    rows = ordered(df, key)
    # only the picks meet in the join; own columns come back with the small result
    drawn = rows.where((F.col("rn") > warm) & (hash01([F.col(key)], f"{seed}:draw") < p))
    picks = drawn.select(F.col(key).alias("own_key"), F.col(url).alias("own_url"), "rn", F.explode(F.sequence(F.lit(0), F.lit(tries))).alias("k"))
    offset = hash_int(seeded([F.col("own_key"), F.col("k")], seed)) % F.least(F.col("rn") - 1, F.lit(pool))
    picks = picks.select("own_key", "own_url", "k", (F.col("rn") - 1 - offset).alias("rn"))
    others = rows.select("rn", F.col(key).alias("partner_key"), F.col(url).alias("partner_url"))
    found = picks.join(others, "rn")
    rank = F.when(~F.col("partner_url").eqNullSafe(F.col("own_url")), F.col("k")).otherwise(F.lit(1000) - F.col("k"))
    chosen = found.groupBy("own_key").agg(F.min(F.struct(rank.alias("o"), "partner_key", "partner_url")).alias("c"))
    return chosen.select(F.col("own_key").alias(key), "c.partner_key", "c.partner_url")


def preceding_pool(df: DataFrame, key: str, size: int = 4096) -> DataFrame:
    """The bounded pool before each row: its size, and its oldest and newest member."""
    rows = ordered(df, key)
    n = F.least(F.col("rn") - 1, F.lit(size)).cast("long")
    members = rows.select("rn", F.col(key).alias("member"))
    sized = rows.select(key, "rn", n.alias("pool_size"))
    oldest = sized.withColumn("at", F.col("rn") - F.col("pool_size")).join(members.select(F.col("rn").alias("at"), F.col("member").alias("oldest")), "at")
    newest = oldest.withColumn("prev", F.col("rn") - 1).join(members.select(F.col("rn").alias("prev"), F.col("member").alias("newest")), "prev", "left")
    return newest.select(key, "pool_size", F.when(F.col("pool_size") > 0, F.col("oldest")).alias("oldest"), "newest")


def capped_hits(df: DataFrame, key: str, p: float, most: int, seed: int) -> DataFrame:
    """The first ``most`` rows, in key order, of those that a Bernoulli draw picks."""
    hits = df.where(hash01([F.col(key)], seed) < p)
    return ordered(hits, key, "hit").where(F.col("hit") <= most)


def fan_out(df: DataFrame, missing: Column, partner: Column, max_context: int = 6000, idk: str = CORPUS_IDK, no_context: str = NO_CONTEXT) -> DataFrame:
    """Up to three jobs a row: without context where ``missing``; always the positive one; with another context where ``partner`` is not null.

    The frame has key, query and context; only the positive job needs inference.
    """
    kind = "struct<kind:string,context:string,is_negative:boolean,needs_infer:boolean,answer:string>"
    job = lambda k, c, neg, infer, ans: F.struct(
        F.lit(k).alias("kind"), c.alias("context"), F.lit(neg).alias("is_negative"), F.lit(infer).alias("needs_infer"), F.lit(ans).alias("answer")
    ).cast(kind)
    jobs = F.array_compact(
        F.array(
            F.when(missing, job("missing", F.lit(""), True, False, no_context)),
            job("positive", truncate_chars(F.col("context"), max_context), False, True, ""),
            F.when(partner.isNotNull(), job("mismatched", truncate_chars(partner, max_context), True, False, idk)),
        )
    )
    return df.select("key", strip(F.col("query")).alias("query"), F.posexplode(jobs).alias("job_no", "job")).select("key", "query", "job_no", "job.*")


def grounded(answer: Column, quotes: Column, context: Column, idk: str = CORPUS_IDK, no_context: str = NO_CONTEXT) -> Column:
    """Refusals pass; other answers need quotes, each non-blank and found verbatim in the context."""
    ok = F.forall(quotes, lambda q: F.coalesce((strip(q) != "") & F.contains(context, q), F.lit(False)))
    return strip(answer).isin(idk, no_context) | (F.coalesce(F.size(quotes) > 0, F.lit(False)) & ok)
