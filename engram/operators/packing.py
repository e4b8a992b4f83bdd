"""Budget packing of ranked texts, as a fold over a sorted array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(items: Column, budget: int, per_entry: int = 600) -> Column:
    """struct(taken, used, skipped, ids) over ``items`` = array of struct(rank, memory_id, label, text), best first.

    Texts are trimmed and shortened to ``per_entry`` characters with an ellipsis; what doesn't fit is skipped,
    and later, shorter ones may still fit.
    """
    budget, per_entry = max(200, budget), max(80, per_entry)

    def body(x: Column) -> Column:
        t = F.trim(F.coalesce(x.text, F.lit("")))
        return F.when(F.length(t) > per_entry, per_entry).otherwise(F.length(t))

    start = F.struct(F.lit(0).alias("taken"), F.lit(0).alias("used"), F.lit(0).alias("skipped"), F.array().cast("array<bigint>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        size = F.length(x.label) + 1 + body(x) + 2
        fits = a.used + size <= budget
        return F.struct((a.taken + fits.cast("int")).alias("taken"), (a.used + F.when(fits, size).otherwise(0)).alias("used"), (a.skipped + (~fits).cast("int")).alias("skipped"), F.when(fits, F.concat(a.ids, F.array(x.memory_id))).otherwise(a.ids).alias("ids"))

    return F.aggregate(F.array_sort(items), start, step)
