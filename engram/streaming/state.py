"""Keyed state over streams: one active write for each key, with back-dated rows, expiry and time to live.

A keyed write retires the key's active row. What counts is arrival, not event time: a back-dated write is accepted and becomes the active
row, and the row before it ends at the write's own time, even if that is earlier than its start. State is held by RocksDB, one value for
each key; by default it grows with the number of keys and nothing is dropped. Options:

* ``late``: a watermark on event time; rows older than it are refused.
* ``idle``: a key without a write for so long, in event time, is closed and its state removed, by a timer when the watermark passes
  or at the next write, whichever comes first, so that the outcome doesn't depend on how the stream was cut into batches.
* ``ttl``: the state is forgotten so long after its last write, in processing time, by the state store itself; nothing is emitted. Such a stream
  never runs out of batches: it goes on until stopped, or takes one batch (``drained(one_batch=True)``).

A batch's writes of one key are put in the order of arrival in one task; the batch, not the key's history, bounds them, and the
source's ``maxBytesPerTrigger`` bounds the batch.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import new_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "state_key string, memory_id long, change string, successor long, at double"
Change = Row("state_key", "memory_id", "change", "successor", "at")


class ActiveUnique(StatefulProcessor):
    """From writes (state_key, memory_id, arrival, ts in seconds) to changes: ``opened``; ``replaced`` by a successor at its time; ``expired`` at
    the end of the idle time."""

    def __init__(self, idle: float | None = None, ttl: float | None = None):
        self.idle, self.ttl = idle, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "memory_id long, arrival long, ts double", None if self.ttl is None else int(self.ttl * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.active.get() if self.active.exists() else None
        before = found
        for r in sorted(rows, key=lambda r: (r.arrival, r.memory_id)):
            if found is not None:
                end = None if self.idle is None else found[2] + self.idle
                if end is not None and r.ts >= end:
                    yield Change(key[0], found[0], "expired", None, end)
                else:
                    yield Change(key[0], found[0], "replaced", r.memory_id, r.ts)
            yield Change(key[0], r.memory_id, "opened", None, r.ts)
            found = (r.memory_id, r.arrival, r.ts)
        if found is None:
            return
        self.active.update(tuple(found))
        if self.idle is not None:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(found))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.active.exists():
            found = self.active.get()
            yield Change(key[0], found[0], "expired", None, found[2] + self.idle)
            self.active.clear()

    def _end(self, found: tuple) -> int:
        return int((found[2] + self.idle) * 1000)

    def close(self) -> None:
        pass


def table_stream(spark: SparkSession, sf_dir: str, name: str, most: int = 256 << 20) -> DataFrame:
    """A table's files as a stream, oldest first, at most about ``most`` bytes in a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # The path is a pattern, as a table may be one file, and a stream reads folders or patterns.
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", most).parquet(f"{sf_dir}/{name}.parque[t]")


def active_unique(writes: DataFrame, *, late: str | None = None, idle: float | None = None, ttl: float | None = None) -> DataFrame:
    """Changes of a stream of writes (state_key, memory_id, arrival, ts). Writes without a key play no part."""
    if ttl is not None and (late is not None or idle is not None):
        raise ValueError("a time to live is in processing time; a watermark and idle time are in event time")
    keyed = writes.filter("state_key is not null").select("state_key", "memory_id", "arrival", "ts")
    mode = "None"
    if late is not None or idle is not None:
        keyed, mode = keyed.withColumn("event_time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))).withWatermark("event_time", late or "0 seconds"), "EventTime"
    elif ttl is not None:
        mode = "ProcessingTime"
    return keyed.groupBy("state_key").transformWithState(ActiveUnique(idle, ttl), CHANGES, "Append", mode)


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """State stores of queries that start in here are RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def drained(stream: DataFrame, folder: str | None = None, *, one_batch: bool = False) -> DataFrame:
    """All that a stream has now, written exactly once into ``folder``, from where a later call with the same folder goes on. ``one_batch``: in a single
    batch; state with a time to live needs it, as in processing time there is always a further batch to wait for."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark)
    with rocks(spark):
        run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(**({"once": True} if one_batch else {"availableNow": True})).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def resolved(changes: DataFrame) -> DataFrame:
    """(state_key, memory_id, superseded_by, valid_to, status) of every write: active, replaced or expired."""
    ended = F.col("change") != "opened"
    per = changes.groupBy("state_key", "memory_id").agg(F.max("successor").alias("superseded_by"), F.max(F.when(ended, F.col("at"))).alias("valid_to"), F.max(F.when(ended, F.col("change"))).alias("status"))
    return per.withColumn("status", F.coalesce("status", F.lit("active")))
