"""A status log of jobs: events are only appended, the last state of a job is an aggregate, and old events are compacted into it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "job string, attempt int, event string, at long, detail string"
#: Events of an attempt in the order in which they can happen.
KINDS = ("start", "fail", "finish")
STATES = {"start": "running", "fail": "failed", "finish": "finished"}


def append_events(events: DataFrame, path: str, batch: int) -> None:
    """Add a batch of ``EVENTS`` rows. A replay under the same number replaces what its first try has left; one of a compacted batch adds nothing."""
    if batch > max(_numbers(events.sparkSession, path, "snapshots"), default=-1):
        _write(events.select(*[c.split()[0] for c in EVENTS.split(", ")]), path, "events", batch)


def _write(rows: DataFrame, path: str, kind: str, number: int) -> None:
    """A numbered table, and then the line that makes it count, so that readers see all of it or nothing."""
    rows.write.mode("overwrite").parquet(f"{path}/{kind}/{number}")
    rows.sparkSession.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").json(f"{path}/{kind}-done/{number}")


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the tables that have been written whole."""
    try:
        return [r[0] for r in spark.read.schema("number long").json(f"{path}/{kind}-done/*").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def next_batch(spark: SparkSession, path: str) -> int:
    """The number for a writer's next batch."""
    return max([-1, *_numbers(spark, path, "events"), *_numbers(spark, path, "snapshots")]) + 1


def _last(rows: DataFrame) -> DataFrame:
    """One row for each job: of its last attempt the last kind of event, of equals the latest, then the greatest detail (null first)."""
    order = F.struct("attempt", F.array_position(F.array(*map(F.lit, KINDS)), F.col("event")).alias("kind"), "at", "detail", "event")
    best = rows.groupBy("job").agg(F.max(order).alias("e"))
    return best.select("job", "e.attempt", "e.event", "e.at", "e.detail")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(job, attempt, event, at, detail, state): the last state of every job, the newest snapshot and the batches after it read once.

    The maximum doesn't mind repeats or disorder, so replayed events change nothing. A job of unknown events has a null state.
    """
    upto = max(_numbers(spark, path, "snapshots"), default=-1)
    rows = [spark.read.schema(EVENTS).parquet(f"{path}/snapshots/{upto}")] if upto >= 0 else []
    if newer := [f"{path}/events/{n}" for n in _numbers(spark, path, "events") if n > upto]:
        rows.append(spark.read.schema(EVENTS).parquet(*newer))
    if not rows:
        rows = [spark.createDataFrame([], EVENTS)]
    state = F.coalesce(*[F.when(F.col("event") == k, v) for k, v in STATES.items()])
    return _last(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])).withColumn("state", state)


def compact(spark: SparkSession, path: str) -> int:
    """Write the last states as a snapshot that stands for all batches so far; returns the last batch it covers.

    Batches are numbered by one writer, in order. A reader sees the new snapshot once it is whole; a failed one is ignored and written
    again. Covered events are not read again and may be deleted.
    """
    upto = max(_numbers(spark, path, "events"), default=-1)
    if upto > max(_numbers(spark, path, "snapshots"), default=-1):
        _write(latest(spark, path).drop("state"), path, "snapshots", upto)
    return upto


def unfinished(jobs: DataFrame, states: DataFrame, retries: int = 2) -> DataFrame:
    """(job, attempt): what to run next: jobs without a state, and failed ones that have been tried fewer than ``retries`` + 1 times."""
    known = jobs.select("job").distinct().join(states.select("job", "attempt", "state"), "job", "left")
    again = F.col("state").isNull() | ((F.col("state") == "failed") & (F.col("attempt") < retries))
    return known.where(again).select("job", (F.coalesce("attempt", F.lit(-1)) + 1).alias("attempt"))
