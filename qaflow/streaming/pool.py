"""Structured Streaming: the stateful context pool, idempotent micro-batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POOL_SCHEMA = "lane int, event_id long, partner_id long, pool_size int"
DRAW_SCHEMA = "lane int, event_id long, partner_id long, partner_url string, partner_context string, tries int, pool_size int"


def _hash(*parts) -> int:
    """The first 32 bits of the md5 of the parts joined by colons."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


#: Rows that are Python objects at a time, and at most in a frame that is given out.
_CHUNK = 10_000


def _in_order(frames):
    """(event_id, url, context) of all frames by event_id; they are held as Arrow columns, 32 bytes a row beside the texts."""
    kinds = {"event_id": pa.int64(), "url": pa.large_string(), "context": pa.large_string()}
    whole = pa.concat_tables(pa.table({c: pa.array(f[c], kind, from_pandas=True) for c, kind in kinds.items()}) for f in frames).combine_chunks().to_batches()[0]
    order = np.argsort(whole.column(0).to_numpy(zero_copy_only=False), kind="stable")
    for at in range(0, len(order), _CHUNK):
        part = whole.take(pa.array(order[at : at + _CHUNK]))
        yield from zip(*(c.to_pylist() for c in part.columns))


def _processor(size: int, warm: int, seed: int, ratio: float, retries: int):
    from pyspark.sql.streaming import StatefulProcessor

    names = ["lane", "event_id", "partner_id", "partner_url", "partner_context", "tries", "pool_size"]

    class PoolProcessor(StatefulProcessor):
        """A ring of the last ``size`` rows of a lane: row number n lies in slot n modulo ``size``.

        A row costs one write and as many reads as it takes draws; slots that a batch has read or written are looked up once.
        """

        def init(self, handle) -> None:
            self.rows = handle.getValueState("rows", "n long")
            self.ring = handle.getMapState("ring", "slot int", "event_id long, url string, context string")

        def handleInputRows(self, key, rows, timerValues):
            n = self.rows.get()[0] if self.rows.exists() else 0
            known: dict[int, tuple] = {}
            written: set[int] = set()
            out: list[tuple] = []
            for event, url, context in _in_order(rows):
                held = min(n, size)
                if held >= warm and held and _hash(event, seed, "draw") < ratio * 4294967296.0:
                    tries = 0
                    while True:
                        pick = _hash(event, seed, tries) if tries else _hash(event, seed)
                        slot = (n - held + pick % held) % size
                        if slot not in known:
                            known[slot] = self.ring.getValue((slot,))
                        if tries == retries or known[slot][1] != url:
                            break
                        tries += 1
                    out.append((key[0], event, *known[slot], tries, held))
                    if len(out) == _CHUNK:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                known[n % size] = (event, url, context)
                written.add(n % size)
                n += 1
            for slot in written:
                self.ring.updateValue((slot,), known[slot])
            self.rows.update((n,))
            yield pd.DataFrame(out, columns=names)

        def close(self) -> None:
            pass

    return PoolProcessor()


def draw_stream(events: DataFrame, lanes: int = 64, size: int = 4096, warm: int = 256, ratio: float = 0.35, retries: int = 10, seed: int = 3) -> DataFrame:
    """Rows (event_id, url, context) paired with an earlier one of their lane, for mismatched contexts.

    Once ``warm`` rows of the lane have gone before, a row is drawn for at the rate ``ratio``: it gets one of the last ``size`` rows, and
    another one up to ``retries`` times while that has the same url (null and empty are the same one); the last draw stands. All
    draws are hashes of event_id, so a replay gives the same pairs. Within a micro-batch rows go by event_id. A lane's rows of
    one batch are held as Arrow columns, their texts once, so where texts are long bound batches by the source (``maxFilesPerTrigger``) and spread hot inputs by more lanes.
    """
    url, context = F.coalesce("url", F.lit("")).alias("url"), F.coalesce("context", F.lit("")).alias("context")
    keyed = events.select(F.pmod("event_id", F.lit(lanes)).cast("int").alias("lane"), F.col("event_id").cast("long").alias("event_id"), url, context)
    return keyed.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=_processor(size, warm, seed, ratio, retries), outputStructType=DRAW_SCHEMA, outputMode="Append", timeMode="None"
    )


def pool_stream(events: DataFrame, lanes: int = 64, size: int = 64, warm: int = 4, seed: int = 3) -> DataFrame:
    """Pair each event with an earlier one of its lane; lanes bound the state and spread the work."""
    bare = events.select("event_id", F.lit("").alias("url"), F.lit("").alias("context"))
    return draw_stream(bare, lanes, size, warm, 1.0, 0, seed).select("lane", "event_id", "partner_id", "pool_size")


def use_state_store(spark: SparkSession) -> None:
    """State with maps and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def append_available(rows: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Append what a stream gives for the input that is there now; a restart with the same checkpoint goes on with what is new."""
    use_state_store(rows.sparkSession)
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(target)


def run_pool(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, **options) -> DataFrame:
    """``pool_stream`` over what is there now."""
    use_state_store(spark)
    return append_available(pool_stream(spark.readStream.schema(schema).parquet(source), **options), target, checkpoint)


def pool_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(lane, slot, event_id, url, context): the rings that a finished run has left in its checkpoint."""
    ring = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "ring").load()
    return ring.select(F.col("key.lane").alias("lane"), F.col("user_map_key.slot").alias("slot"), "user_map_value.*")


def pool_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(lane, n): the rows that each lane has seen."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows").load().select("key.lane", "value.n")


def process_batches(stream: DataFrame, work, done_path: str, key: str, checkpoint: str):
    """Run ``work`` on the rows of each micro-batch whose key is not yet among the outputs, and append its result.

    A batch that is replayed after a failure therefore adds nothing twice.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(done_path).select(key)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            done = None
        fresh = batch.dropDuplicates([key])
        fresh = fresh if done is None else fresh.join(done, key, "left_anti")
        work(fresh).write.mode("append").parquet(done_path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
