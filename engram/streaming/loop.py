"""The capture loop: each message first recalls what was stored before it, then is stored.

A micro-batch is handled in one go with the result of doing its messages one by one: a message sees what earlier batches stored, and of its own
batch what is earlier than itself. All outputs of a batch lie under its number and are written over when the batch is repeated; what it reads are
lower numbers and its own messages. So a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lenient
from ..functions import text as T
from ..functions import vector as V
from ..operators import order

STORED = "memory_id long, text string, source string, tags array<string>, ts double, embedding array<double>, batch long"


def captured(messages: DataFrame) -> DataFrame:
    """Messages (message_id, app, context, response, ts) as (…, text, outcome, embedding): the text to store, and ``stored`` or why not."""
    response = F.coalesce("response", F.lit(""))
    text = F.concat(F.coalesce("context", F.lit("")), F.when(response != "", F.concat(F.lit(" ||| "), response)).otherwise(""))
    rows = messages.withColumn("text", text)
    rows = rows.withColumn("outcome", F.when(T.has_credential(F.col("text")), "credential").when(T.is_junk(F.col("text")), "junk").otherwise("stored"))
    return rows.withColumn("embedding", lenient.embed_double(F.array_sort(T.tokens(F.col("text"))))).withColumn("asked", lenient.embed_double(F.array_sort(T.tokens(F.coalesce("context", F.lit(""))))))


def answers(rows: DataFrame, memory: DataFrame, *, k: int = 3, floor: float = 0.4, recent: int = 6, minutes: float = 90, asks: Column | None = None) -> DataFrame:
    """(message_id, channel, rank, memory_id, sim): for each captured message that asks, ``recalled`` entries of ``memory`` (the ``k`` most similar
    that are earlier, above ``floor``), and ``recent`` ones: the newest of the last minutes, without those recalled."""
    queries = (rows if asks is None else rows.filter(asks)).select(F.col("message_id").alias("query_id"), F.col("asked").alias("embedding"), "ts")
    found = V.nearest(memory.select("memory_id", "embedding", "ts"), queries, k, before="ts").filter(F.col("sim") > floor)
    found = found.select("query_id", F.lit("recalled").alias("channel"), (F.col("rank") + 1).cast("int").alias("rank"), "memory_id", "sim")
    trail = order.latest_before(memory.select("memory_id", "ts"), queries.select("query_id", "ts"), recent, minutes * 60)
    trail = trail.join(found.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    trail = trail.select("query_id", F.lit("recent").alias("channel"), "rank", "memory_id", F.lit(None).cast("double").alias("sim"))
    return found.unionByName(trail).withColumnRenamed("query_id", "message_id")


def handle(messages: DataFrame, batch: int, folder: str, asks: Column | None = None) -> None:
    """One micro-batch: its entries to ``folder``/stored, what its messages recalled to /recalled and what became of them to /outcomes."""
    spark = messages.sparkSession
    rows = captured(messages)
    at = f"{folder}/captured/batch={batch}"
    rows.write.mode("overwrite").parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    stored = rows.filter("outcome = 'stored'").select(F.col("message_id").alias("memory_id"), "text", F.lit("hook").alias("source"), F.array(F.lit("auto"), F.concat(F.lit("app:"), "app")).alias("tags"), "ts", "embedding")
    stored.write.mode("overwrite").parquet(f"{folder}/stored/batch={batch}")
    memory = spark.read.schema(STORED).parquet(f"{folder}/stored").filter(F.col("batch") <= batch)
    answers(rows, memory, asks=asks).write.mode("overwrite").parquet(f"{folder}/recalled/batch={batch}")
    rows.select("message_id", "outcome").write.mode("overwrite").parquet(f"{folder}/outcomes/batch={batch}")


def capture_loop(messages: DataFrame, folder: str, asks: Column | None = None, prepare=None) -> DataFrame:
    """Run the loop over all that a stream of messages has now; the rows recalled so far. ``prepare`` makes messages of a batch's rows."""
    spark = messages.sparkSession

    def each(df: DataFrame, batch: int) -> None:
        handle(prepare(df) if prepare else df, batch, folder, asks)

    run = messages.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("message_id long, channel string, rank int, memory_id long, sim double, batch long").parquet(f"{folder}/recalled")
