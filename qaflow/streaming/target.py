"""A stream that stops at an exact number of output rows, whatever its micro-batches hold and however often it is restarted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaflow.operators.sampling import shuffle_rank

LOG = "batch long, folder string, rows long"


class TargetReached(Exception):
    """Ends the query before a batch that isn't wanted; the checkpoint then has that batch as not yet done."""


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG).json(f"{path}/log/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed_rows(spark: SparkSession, path: str, before: int | None = None) -> int:
    """Rows of the committed batches, or of those with a number under ``before``."""
    log = _log(spark, path)
    if log is None:
        return 0
    return (log if before is None else log.where(F.col("batch") < before)).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def read_committed(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The rows of the committed batches; what a failed attempt has left is no part of it. None before the first commit."""
    log = _log(spark, path)
    folders = [] if log is None else [r["folder"] for r in log.where("rows > 0").select("folder").collect()]  # one short name for each batch
    if not folders:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{path}/data/{f}" for f in folders])


def run_to_target(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: int, keys: list[str], path: str, checkpoint: str, seed: int = 0) -> int:
    """Append ``work`` of each micro-batch to ``path`` until exactly ``target`` rows are committed; returns the committed rows.

    Each attempt at a batch writes a folder of its own; the batch is committed by its line in the log, which a replay
    overwrites. The rows so far are those of the log's earlier batches, so a replayed batch neither doubles nor overshoots. The
    batch that would pass the target is cut to it by a seeded hash of ``keys``, which has to identify a row; the query then
    stops, and a restart adds nothing until the target is raised, when it goes on with the next batch. Fewer rows come only if
    the input ends.
    """
    reached = False

    def each(batch: DataFrame, number: int) -> None:
        nonlocal reached
        spark = batch.sparkSession
        wanted = target - committed_rows(spark, path, number)
        if wanted <= 0:
            reached = True
            raise TargetReached(f"{target} rows are committed before batch {number}")
        folder = f"batch-{number}-{uuid.uuid4().hex}"
        work(batch).write.parquet(f"{path}/data/{folder}")
        rows = spark.read.parquet(f"{path}/data/{folder}")
        n = rows.count()  # from the footers
        if n > wanted:
            cut = shuffle_rank(rows, keys, seed, name="__rank").where(F.col("__rank") <= wanted).drop("__rank")
            folder, n = f"{folder}-cut", wanted
            cut.write.parquet(f"{path}/data/{folder}")
        line = spark.createDataFrame([(number, folder, n)], LOG)
        line.coalesce(1).write.mode("overwrite").json(f"{path}/log/batch-{number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not reached:
            raise
    return committed_rows(stream.sparkSession, path)
