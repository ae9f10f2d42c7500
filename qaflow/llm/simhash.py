"""SimHash near-duplicate classes with covering locality-sensitive hashing.

A fingerprint is 64 bits. For radius r every bit position gets a code of r+1 bits, and for each non-zero
vector v of r+1 bits there is a table whose mask keeps the positions whose code has odd parity with v.
The codes of the (at most r) differing positions of a linked pair span at most r dimensions, so some v
is orthogonal to all of them: in that table both fingerprints agree on the whole mask. With r = 4 there
are 31 tables of about 32 bits, and every pair within the radius meets in at least one.

Equal fingerprints are merged before the tables. A bucket is searched in one task as long as it has at
most ``most`` fingerprints. A larger one is split again by the pigeonhole rule on its free bits (r+1
blocks, one of which must agree), and what is still larger is compared block by block, with a task for
each pair of blocks. Each search returns the edges of a forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaflow.llm.common import join_small, materialize, packed, unpacked
from qaflow.llm.components import connected_components

RADIUS = 4
SEED = 42


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks. Codes run through all non-zero vectors, so each mask keeps about half the bits."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def free_blocks(mask: int, radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bits that ``mask`` leaves free, dealt into radius + 1 masks."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_FEW = 1 << 14


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """Fingerprint of one UTF-8 text: A-Z lower-cased, words between ASCII white space, ``size``-word shingles with repeats.

    Fewer words than ``size`` make one shingle; no word at all makes zero.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths + 1) - 1
        starts, ends = (stops - lengths)[: len(words) - size + 1].tolist(), stops[size - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _FEW):
        part = [digest(joined[i:j], SEED) for i, j in zip(starts[a : a + _FEW], ends[a : a + _FEW])]
        raw = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp), one row per input row; fp is a signed long, text_key a hash of the text; null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, text_key long, fp long"
    )


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (first member, other member) of the components under "at most ``radius`` bits apart"."""
    edges, rest = [], np.asarray(fps, np.int64)  # bitwise_count takes absolute values, hence the unsigned views below
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            near = np.bitwise_count((rest ^ todo.pop()).view(np.uint64)) <= radius
            if near.any():
                found = rest[near].tolist()
                rest = rest[~near]
                todo.extend(np.int64(x) for x in found)
                edges.extend((int(first), x) for x in found)
    return edges


def _search(radius: int, most: int | None):
    """Streams key-sorted rows; yields edges, and a row (key, null) of each bucket over ``most`` instead."""

    def flush(edges, large):
        n, m = len(edges), len(large)
        a = pa.array([x for x, _ in edges] + [None] * m, pa.int64())
        b = pa.array([y for _, y in edges] + [None] * m, pa.int64())
        t = pa.array([None] * n + [x for x, _ in large], pa.int32())
        k = pa.array([None] * n + [y for _, y in large], pa.int64())
        return pa.RecordBatch.from_arrays([a, b, t, k], ["a", "b", "t", "k"])

    def run(batches):
        held_t = held_k = None
        held: list[np.ndarray] = []
        held_n = 0
        edges: list = []
        large: list = []

        def close():
            nonlocal held, held_n
            if held_n > 1:
                if most is not None and held_n > most:
                    large.append((held_t, held_k))
                else:
                    edges.extend(forest(np.concatenate(held), radius))
            held, held_n = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
            last = len(starts) - 1
            # inner groups of one row hold no pair; the first and last group may go on in other batches
            busy = np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last))
            for g in busy.tolist():
                s, e = int(starts[g]), int(ends[g])
                if (held_t, held_k) != (t[s], k[s]):
                    close()
                    held_t, held_k = int(t[s]), int(k[s])
                if most is None or held_n <= most:
                    held.append(fp[s:e])
                held_n += e - s
                if g != last:
                    close()
                    held_t = None
            if len(edges) + len(large) > 50_000:
                yield flush(edges, large)
                edges, large = [], []
        close()
        yield flush(edges, large)

    return run


_FOUND = "a long, b long, t int, k long"


def _buckets(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("t", "k", "fp").repartition(n, "t", "k").sortWithinPartitions("t", "k")


def _masked(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]))


def links(fps: DataFrame, radius: int = RADIUS, most: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose closure equals that of all pairs within ``radius``."""
    masks = covering_masks(radius)
    tables = fps.select("fp", _masked(F.col("fp"), masks).alias("x")).select("fp", "x.t", "x.k")
    found = materialize(_buckets(tables).mapInArrow(_search(radius, most), _FOUND), "covering")
    edges, over = found.where("a IS NOT NULL").select("a", "b"), found.where("k IS NOT NULL").select("t", "k")
    if over.isEmpty():
        return edges
    # large buckets: one of radius + 1 blocks of the free bits agrees too; tables are numbered on from 31
    finer = [free_blocks(m, radius) for m in masks]
    hot = materialize(tables.join(over, ["t", "k"], "left_semi").select("t", "fp"), "hot")
    blocks = F.array(*[F.array(*[F.lit(_signed(x)) for x in group]) for group in finer])
    split = hot.select("t", "fp", F.posexplode(F.get(blocks, F.col("t"))).alias("j", "m")).select(
        (F.lit(len(masks)) + F.col("t") * (radius + 1) + F.col("j")).cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp"
    )
    found = materialize(_buckets(split).mapInArrow(_search(radius, most), _FOUND), "split")
    edges = edges.unionByName(found.where("a IS NOT NULL").select("a", "b"))
    over = found.where("k IS NOT NULL").select("t", "k")
    if over.isEmpty():
        return edges
    # what is still large is dealt into blocks; each pair of blocks is a task of at most 2 * most fingerprints or so
    still = split.join(over, ["t", "k"], "left_semi")
    counts = still.groupBy("t", "k").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("n"))
    dealt = still.join(counts, ["t", "k"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = dealt.select("t", "k", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    keyed = pairs.select("t", F.xxhash64("k", F.least("i", "j"), F.greatest("i", "j")).alias("k"), "fp")
    found = materialize(_buckets(keyed).mapInArrow(_search(radius, None), _FOUND), "blocks")
    return edges.unionByName(found.where("a IS NOT NULL").select("a", "b"))


def _spread_join(prints: DataFrame, named: DataFrame, hot: DataFrame) -> DataFrame:
    """Join on the fingerprint. Rows of the ``hot`` ones (fp, salts) are dealt over their salts, and their names are repeated for each."""
    spread = F.xxhash64("doc_id", "text_key", F.spark_partition_id())
    salts = F.coalesce("salts", F.lit(1))
    dealt = join_small(prints, hot, ["fp"], spread, "left").withColumn("salt", F.pmod(spread, salts).cast("int")).drop("salts")
    names = join_small(named, hot, ["fp"], F.xxhash64("fp"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1))).drop("salts")
    return dealt.join(names, ["fp", "salt"]).drop("salt")


def classes(docs: DataFrame, radius: int = RADIUS, most: int = 4096, hot: int = 1 << 20) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id), one row per input row; ``root`` names the class.

    component_id is the least doc_id reachable over links, itself included. Null and empty texts have
    the fingerprint zero and link like any other. A null doc_id is a component's id only if all its
    members' are null. Texts of any length are fingerprinted whole. A fingerprint of more than ``hot`` rows is joined in parts of about that size. Repeated rows stay; columns besides doc_id and text are ignored; an empty table
    gives an empty result.
    """
    prints = materialize(fingerprints(docs), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius, most))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    large = materialize(nodes.where(F.col("n") > hot).select("fp", F.ceil(F.col("n") / hot).cast("long").alias("salts")), "hot")
    joined = prints.join(named, "fp") if large.isEmpty() else _spread_join(prints, named, large)
    return joined.select("doc_id", "text_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 lowercase hex digits, component_id; see ``classes``, also for nulls, repeats and very long texts."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate class, all columns kept.

    The row with the least doc_id stays (null last; then the least text hash). Rows repeated with the
    same doc_id and text stay once. Rows are named by doc_id and text hash, so a doc_id that is used for different
    texts does no harm. Null and empty texts are one class; an empty table gives an empty result.
    """
    found = materialize(classes(docs), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    # by aggregation alone, so that a class of any size is combined before the shuffle
    best = found.groupBy("root").agg(F.min(rank).alias("best"))
    doc_key = lambda c: F.coalesce(c.cast("string"), F.lit("null")).alias("doc_key")
    keys = materialize(best.select(doc_key(F.col("best.doc_id")), "best.text_key"), "kept")
    repeated = not found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    # the keys are one to a document: a hash table of a partition's keys spares sorting the texts
    kept = packed(docs, doc_key(F.col("doc_id")), _text_key()).join(keys.hint("shuffle_hash"), ["doc_key", "text_key"], "left_semi")
    return unpacked(kept.dropDuplicates(["doc_key", "text_key"]) if repeated else kept, docs.columns)
