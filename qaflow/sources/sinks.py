"""Writers: sharded Parquet, JSON lines, CSV, dead letters and one-row documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from qaflow.operators.sampling import shuffle_rank


def write_shards(df: DataFrame, path: str, rows_per_shard: int, mode: str = "append", codec: str = "zstd") -> None:
    """Parquet files of at most ``rows_per_shard`` rows; an append adds files and rewrites none."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_shard).option("compression", codec).parquet(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet rows at ``path``, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_shards(df: DataFrame, keys: list[str], path: str, rows_per_shard: int, seed: int = 0) -> None:
    """Append to folders ``shard=0``, ``shard=1``, ... of exactly ``rows_per_shard`` rows each; the last one may hold fewer and is filled up first.

    Only the number of rows so far is needed, which the footers give; no file is rewritten or removed, so a
    failed append leaves what was there. Rows are numbered by a seeded hash of ``keys``.
    """
    before = 0 if (rows := existing(df.sparkSession, path)) is None else rows.count()
    ranked = shuffle_rank(df, keys, seed, name="__n")
    shard = F.floor((F.col("__n") + F.lit(before - 1)) / rows_per_shard).cast("int")
    ranked.withColumn("shard", shard).drop("__n").write.mode("append").partitionBy("shard").parquet(path)


def rank_dir(path: str, rank: int) -> str:
    """The output folder of one rank beside the common one."""
    return f"{path}.rank{rank}"


def write_new(df: DataFrame, path: str, allow_existing: bool = False) -> None:
    """Refuses an existing folder unless allowed; a rebuild overwrites, so no old rows leak into new splits."""
    df.write.mode("overwrite" if allow_existing else "errorifexists").parquet(path)


def write_splits(df: DataFrame, path: str, rows_per_shard: int = 200_000) -> None:
    """One folder per (split, class); reading a parent folder gives the union."""
    df.write.partitionBy("split", "example_type").option("maxRecordsPerFile", rows_per_shard).mode("errorifexists").parquet(path)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_dead_letters(df: DataFrame, path: str) -> None:
    write_lines(df, path, "append")


def write_worker_tasks(planned: DataFrame, path: str) -> None:
    """One folder of task lines per worker; stale ones go."""
    planned.write.mode("overwrite").partitionBy("worker").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A small table as one JSON document per row in one file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of a given name, such as a run's summary, on any file system that Spark knows."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def next_shard(files: DataFrame) -> DataFrame:
    """The next free shard number of a frame of ``file`` names: highest part number plus one, 0 without any."""
    number = F.regexp_extract("file", "part-([0-9]+)[^/]*\\.parquet$", 1).try_cast("int")
    return files.agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("next_shard"))


def routed(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) by whether ``reason`` is null."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


class Outcomes:
    """Counts of written and failed rows, taken while the rows are written instead of by a scan of their own.

    ``reasons`` are the known ones, each counted by itself; any other counts as ``other``. A write has to run on what
    ``written`` and ``failed`` return, once each, before ``table`` is asked, which waits for it.
    """

    def __init__(self, reasons: tuple[str, ...]) -> None:
        self.reasons, self.seen = reasons, []

    def _observed(self, df: DataFrame, **counts) -> DataFrame:
        self.seen.append(Observation())
        return df.observe(self.seen[-1], *[c.alias(k) for k, c in counts.items()])

    def written(self, df: DataFrame) -> DataFrame:
        return self._observed(df, written=F.count(F.lit(1)))

    def failed(self, df: DataFrame, reason: str = "reason") -> DataFrame:
        counts = {r: F.count_if(F.col(reason) == r) for r in self.reasons}
        return self._observed(df, **counts, other=F.count_if(~F.coalesce(F.col(reason).isin(*self.reasons), F.lit(False))))

    def table(self, spark: SparkSession) -> DataFrame:
        """(outcome, rows), outcomes without rows left out."""
        found = [(k, n) for o in self.seen for k, n in o.get.items() if n]
        return spark.createDataFrame(found, "outcome string, rows long")
