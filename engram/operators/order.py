"""Places in a total order, without ordering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def before(rows: DataFrame, order: list[str], counted: Column | None = None, name: str = "before") -> DataFrame:
    """``rows`` with the number of ``counted`` rows (default: all) that come before each in ascending order of the columns, nulls first.

    Rows are range-partitioned by the order, counted within each partition, and the partitions' totals added: one number for each
    partition passes the driver. Rows that are equal in the order have distinct places only if their place is told apart by a column.
    """
    spark = rows.sparkSession
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.withColumn("_one", one.cast("long")).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals, starts = sorted(dealt.groupBy("_part").agg(F.sum("_one")).collect()), []
    for part, n in totals:
        starts.append((part, starts[-1][1] + starts[-1][2] if starts else 0, n))
    offsets = F.broadcast(spark.createDataFrame(starts, "_part int, _start long, _n long").drop("_n"))
    inside = F.sum("_one").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_in", inside).join(offsets, "_part").withColumn(name, F.col("_start") + F.col("_in") - F.col("_one")).drop("_part", "_one", "_in", "_start")


def latest_before(items: DataFrame, asks: DataFrame, k: int, within: float) -> DataFrame:
    """(query_id, memory_id, rank): for each ask (query_id, ts) the ``k`` newest items (memory_id, ts) earlier than it and at most ``within``
    seconds old, newest first from rank 1; items of one time by id. An as-of join by place: the k places before the ask's."""
    rows = items.select("ts", F.lit(1).alias("kind"), "memory_id", F.lit(None).cast("long").alias("query_id"))
    rows = rows.unionByName(asks.select("ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("memory_id"), "query_id"))  # an ask comes before items of its own time
    placed = written(before(rows, ["ts", "kind", "memory_id", "query_id"], F.col("kind") == 1, "place"))
    wanted = placed.filter("kind = 0").select("query_id", F.col("ts").alias("asked"), "place", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    wanted = wanted.select("query_id", "asked", "rank", (F.col("place") - F.col("rank")).alias("place")).filter("place >= 0")
    found = wanted.join(placed.filter("kind = 1").select("place", "memory_id", "ts"), "place")
    return found.filter(F.col("ts") >= F.col("asked") - within).select("query_id", "memory_id", "rank")
