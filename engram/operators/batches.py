"""Capture batches: entries of one app stored close in time. Hits lead to their batches, and both share a budget of characters.

A batch's bucket is widened (x1, x6, x24) until it holds two entries. All widths are equi-joins on buckets; of a bucket's members only the nearest to
the centre are kept, first within parts of a bucket, then over them, so that no bucket is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Widths of the cascade, in windows.
WIDER = (1, 6, 24)


def batch_keys(hits: DataFrame, window: float, parents: int = 3) -> DataFrame:
    """(query_id, app, key, best, place): the batches of hits (query_id, app, ts, sim, rank), key being floor(ts / window), by their best hit; the best
    ``parents`` of a query, from place 1. Of equal batches the one that was hit first goes first."""
    window = max(0.5, window)
    per = hits.groupBy("query_id", "app", F.floor(F.col("ts") / window).alias("key")).agg(F.max("sim").alias("best"), F.min("rank").alias("_first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "_first"))
    return per.withColumn("place", place).filter(F.col("place") <= parents).drop("_first")


def batch_members(entries: DataFrame, keys: DataFrame, window: float, cap: int = 20, *, parts: int = 32) -> DataFrame:
    """(app, key, wide, memory_id, ts, rank): for each batch (app, key) the active entries of the narrowest bucket of the cascade that holds two, nearest to
    the batch's centre first, ``cap`` (2 at least) of them; batches that stay alone are left out. ``wide`` is the width taken, in windows."""
    window, cap = max(0.5, window), max(2, cap)
    bucket = lambda place, wide: F.floor(place / (wide * window))
    live = entries.filter("superseded_by is null").select("memory_id", "ts", T.first_tag(F.col("tags"), "app:").alias("app"))
    wides = F.array(*map(F.lit, WIDER))
    spread = live.withColumn("wide", F.explode(wides)).withColumn("bucket", bucket(F.col("ts"), F.col("wide")))
    asked = keys.select("app", "key").distinct().withColumn("wide", F.explode(wides)).withColumn("bucket", bucket(F.col("key") * window, F.col("wide")))
    sizes = spread.groupBy("app", "wide", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    taken = asked.join(sizes, ["app", "wide", "bucket"]).groupBy("app", "key").agg(F.min(F.struct("wide", "bucket")).alias("_t"))
    taken = taken.select("app", "key", "_t.wide", "_t.bucket")
    away = F.abs(F.col("ts") - (F.col("key") + 0.5) * window)
    met = spread.join(taken, ["app", "wide", "bucket"]).select("app", "key", "wide", "memory_id", "ts", away.alias("away"), F.pmod(F.xxhash64("memory_id"), F.lit(parts)).alias("part"))
    for by in (["app", "key", "part"], ["app", "key"]):
        met = met.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("away", "memory_id"))).filter(F.col("rank") <= cap)
    return met.select("app", "key", "wide", "memory_id", "ts", "rank")


def laid_out(items: Column, budget: int, per_entry: int = 600) -> Column:
    """struct(taken, used, block): ``items``, an array of struct(rank, label, text), as a block of text, best first. Texts are stripped and shortened
    to ``per_entry`` characters with an ellipsis; what doesn't fit is skipped, and later, shorter ones may still fit."""
    budget, per_entry = max(200, budget), max(80, per_entry)

    def piece(x: Column) -> Column:
        body = T._strip(F.coalesce(x["text"], F.lit("")))
        return F.concat(x["label"], F.lit("\n"), F.when(F.length(body) > per_entry, F.concat(F.left(body, F.lit(per_entry - 1)), F.lit("…"))).otherwise(body))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("pieces"))

    def step(a: Column, p: Column) -> Column:
        fits = a["used"] + F.length(p) + 2 <= budget
        return F.struct((a["used"] + F.when(fits, F.length(p) + 2).otherwise(0)).alias("used"), F.when(fits, F.concat(a["pieces"], F.array(p))).otherwise(a["pieces"]).alias("pieces"))

    def block(a: Column) -> Column:
        taken = F.size(a["pieces"])
        head = F.format_string("[memory block: %d entries, %d chars]", taken, a["used"])
        return F.struct(taken.alias("taken"), a["used"].alias("used"), F.array_join(F.concat(F.array(head), a["pieces"]), "\n\n").alias("block"))

    return F.aggregate(F.transform(F.array_sort(items), piece), start, step, block)


def recall_block(entries: DataFrame, hits: DataFrame, now: float, *, budget: int = 6000, per_entry: int = 600, share: float = 0.4, window: float = 300.0, cap: int = 20, parents: int = 3) -> DataFrame:
    """(query_id, top_sim, taken, used, parents, block) for hits (query_id, memory_id, sim, rank). Hits take ``1 - share`` of the budget; their capture batches
    have the rest, in equal parts of at least 300 characters. With ``share`` 0 there are none."""
    facts = entries.select("memory_id", "text", "ts", T.first_tag(F.col("tags"), "app:").alias("app"), T.apps(F.col("tags")).alias("apps"))
    found = hits.join(facts, "memory_id")
    label = F.format_string("[#%d | %.2f | app=%s | %s]", F.col("memory_id"), F.col("sim"), F.col("apps"), T.age_label(F.col("ts"), now))
    fine = laid_out(F.col("items"), max(400, int(budget * (1 - share))), per_entry)
    blocks = found.groupBy("query_id").agg(F.collect_list(F.struct("rank", label.alias("label"), "text")).alias("items"), F.min_by("sim", "rank").alias("best"))
    blocks = blocks.select("query_id", F.format_string("%.2f", F.col("best")).alias("top_sim"), fine.alias("fine"))
    if not share:
        return blocks.select("query_id", "top_sim", "fine.taken", "fine.used", F.lit(0).alias("parents"), F.concat(F.lit("top_sim="), "top_sim", F.lit("\n"), "fine.block").alias("block"))
    keys = batch_keys(found, window, parents)
    members = batch_members(entries, keys, window, cap).join(entries.select("memory_id", "text"), "memory_id")
    bodies = members.groupBy("app", "key").agg(F.array_sort(F.collect_list(F.struct("rank", "ts", "text"))).alias("m"))  # at most ``cap`` rows
    count = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    room = F.greatest(F.lit(300), F.floor(F.lit(int(budget * share)) / F.col("batches"))).cast("int")
    stamp = F.date_format(F.timestamp_seconds(F.floor(F.col("m")[0]["ts"])), "yyyy-MM-dd HH:mm")
    body = F.left(F.array_join(F.transform("m", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"), room)
    told = keys.withColumn("batches", count).join(bodies, ["app", "key"])
    told = told.select("query_id", "place", F.concat(F.format_string("[capture batch %s · %d entries]", stamp, F.size("m")), F.lit("\n"), body).alias("part"))
    told = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("p")).select("query_id", F.transform("p", lambda x: x["part"]).alias("p"))
    out = blocks.join(told, "query_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("top_sim="), F.col("top_sim")), F.col("fine.block")), F.col("p")), "\n")
    return out.select("query_id", "top_sim", "fine.taken", "fine.used", F.size("p").alias("parents"), text.alias("block"))
