"""Helpers shared by the operators: shared-folder tables, packed rows, let-binding."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where the session has none (unit tests in local mode) a local folder is made and set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="qaflow-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Lets a task write a few partitions of a table side by side instead of sorting its rows by partition first.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Lets Spark delete a query's shuffle files as soon as the query ends; results read from them are in tables by then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, *partitions: str, hashes: tuple[str, ...] = ()) -> None:
    """Write ``df`` as Parquet and drop the shuffle files that this took. Columns named as ``hashes`` never repeat enough for a dictionary to pay."""
    spark = df.sparkSession
    settings = {_CLEANUP: "true", _WRITERS: "4"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")  # two files fewer for each table
        for column in hashes:
            writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/qaflow/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read back, and where it is."""
    path = new_path(df.sparkSession, label)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, on whatever file system it is."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


#: Paths of the tables that open ``temporary_tables`` blocks will delete, the innermost last.
_TEMPORARY: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside the block are deleted at its end; what is to stay has to be written there by ``written``."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        for path in _TEMPORARY.pop():
            delete_table(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of the table, not a recomputation. The table stays, as a
    returned DataFrame may read it, unless ``temporary_tables`` says otherwise; steps whose tables can go earlier use ``Scratch``.
    """
    table, path = written(df, label)
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    return table


class Scratch:
    """Tables of one computation in the shared folder, which can be dropped when used up."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def _hold(self, table: DataFrame, path: str) -> DataFrame:
        self.held[id(table)] = (table, path)
        if _TEMPORARY:
            _TEMPORARY[-1].append(path)
        return table

    def write(self, df: DataFrame, label: str) -> DataFrame:
        return self._hold(*written(df, label))

    def write_kinds(self, df: DataFrame, label: str, *kinds: str, hashes: tuple[str, ...] = ()) -> list[DataFrame]:
        """One job that writes a table for each value of the column ``kind``."""
        path = new_path(self.spark, label)
        write_table(df, path, "kind", hashes=hashes)
        tables = [self.spark.read.schema(df.schema).parquet(path).where(F.col("kind") == kind).drop("kind") for kind in kinds]
        return [self._hold(table, f"{path}/kind={kind}") for table, kind in zip(tables, kinds)]

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete_table(self.spark, self.held.pop(id(table))[1])


def join_small(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, how: str = "inner", most: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """Join ``rows`` with a ``table`` of few distinct keys, any of which may hold a large share of the rows.

    ``table`` is already written and has numbers besides its keys, so counting it and its keys' bytes is cheap. Up to
    ``most`` rows and ``most_bytes`` it is broadcast and the rows stay where they are. Beyond that, rows are dealt over as many
    salts as there are shuffle partitions, and the table is repeated for each, so that no key meets in one task.
    """
    width = 8 * len(table.columns)
    n, size = table.agg(F.count("*"), F.sum(F.octet_length(F.concat_ws("", *keys)) + width)).first()
    if n <= most and (size or 0) <= most_bytes:
        return rows.join(F.broadcast(table), keys, how)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*keys, "__salt"], how).drop("__salt")


def text_blocks(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts stay near ``most_bytes``, so that Python holds few of them at a time."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size > most_bytes:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (higher-order bodies are inlined otherwise)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside computed columns, so that no input name can clash."""
    return df.select(F.struct("*").alias("row"), *extra)


def unpacked(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """Give back the packed row's columns in order, with ``changed`` ones replaced."""
    return df.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in names])


def unit_hash(key: Column, *parts) -> Column:
    """Uniform number in [0, 1) from 32 bits of md5 over the key and the seed parts (same value in DuckDB)."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
