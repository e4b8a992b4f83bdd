"""Decisions over a case's memories, carried out in order: remember, supersede, consolidate, forget.

New entries of a case take ids after its own, so every step can be told from the case alone; the whole is one expression
per case, without a fold over a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def admitted(t: Column) -> Column:
    """Whether a forced write stores the text: it has one, no credential, and isn't junk."""
    return F.coalesce((F.trim(t) != "") & ~T.has_credential(t) & ~T.is_junk(t), F.lit(False))


def execute(cases: DataFrame) -> DataFrame:
    """``cases``: case_id, memories array<struct<id, text>>, remember array<string>, supersede array<struct<old_id,
    remember_index>>, consolidate array<struct<memory_ids, conclusion>>, forget array<struct<memory_id>>.

    Returns case_id, remembered array<boolean>, superseded / consolidated / forgotten arrays of struct(id or ids, reason),
    n_ok and n_errors. Reasons: ``ok``, ``bad_index`` (no such text, or it was refused), ``unknown``, ``too_few``
    (under two distinct known ids), ``refused`` (conclusion not stored). Null arrays count as empty. A forgotten id is known
    only once.
    """
    known = F.transform(F.coalesce("memories", F.expr("cast(array() as array<struct<id:bigint,text:string>>)")), lambda m: m.id)
    df = cases.withColumn("_ids", known)
    df = df.withColumn("remembered", F.transform("remember", admitted))

    def superseded(s: Column) -> Column:
        usable = F.coalesce((s.remember_index >= 0) & F.get("remembered", s.remember_index.cast("int")), F.lit(False))
        return F.struct(s.old_id.alias("id"), F.when(~usable, "bad_index").when(~F.coalesce(F.array_contains("_ids", s.old_id), F.lit(False)), "unknown").otherwise("ok").alias("reason"))

    def consolidated(c: Column) -> Column:
        ids = F.array_sort(F.array_intersect(F.array_distinct(c.memory_ids), F.col("_ids")))
        return F.struct(ids.alias("ids"), F.when(F.coalesce(F.size(ids), F.lit(0)) < 2, "too_few").when(~admitted(c.conclusion), "refused").otherwise("ok").alias("reason"))

    def forgotten(f: Column, i: Column) -> Column:
        again = F.coalesce(F.array_contains(F.transform(F.slice("forget", F.lit(1), i), lambda x: x.memory_id), f.memory_id), F.lit(False))
        return F.struct(f.memory_id.alias("id"), F.when(F.coalesce(F.array_contains("_ids", f.memory_id), F.lit(False)) & ~again, "ok").otherwise("unknown").alias("reason"))

    df = df.select("case_id", F.coalesce("remembered", F.array().cast("array<boolean>")).alias("remembered"), F.transform("supersede", superseded).alias("superseded"), F.transform("consolidate", consolidated).alias("consolidated"), F.transform("forget", forgotten).alias("forgotten"))
    ok = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.reason == "ok")), F.lit(0))
    bad = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.reason != "ok")), F.lit(0))
    done = ("superseded", "consolidated", "forgotten")
    n_ok = F.size(F.filter("remembered", lambda x: x)) + sum((ok(F.col(c)) for c in done), F.lit(0))
    n_bad = F.size(F.filter("remembered", lambda x: ~x)) + sum((bad(F.col(c)) for c in done), F.lit(0))
    return df.select("*", n_ok.alias("n_ok"), n_bad.alias("n_errors"))


def corrections(requests: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """``requests``: (old_id, text). Texts that a write admits become entries with ids from ``first_id`` in the order of old_id, and
    supersede their old row: (memory_id, text) and (old_id, new_id). Ids come from per-partition counts, not from one sorted task."""
    from .graph import checkpointed

    kept = requests.filter(admitted(F.col("text"))).select("old_id", "text").repartitionByRange("old_id").sortWithinPartitions("old_id")
    kept = checkpointed(kept.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    out = kept.join(before, "_p").withColumn("memory_id", F.col("_n") + F.col("_i") + first_id)
    return out.select("memory_id", "text"), out.select("old_id", F.col("memory_id").alias("new_id"))
