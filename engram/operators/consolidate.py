"""Consolidation: conclusions over several entries, validated against the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def consolidate(entries: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``requests``: (request_id, ids, conclusion). Accepted ones become model entries, a row per chunk, each with the
    sorted evidence; refused: fewer than two distinct ids, an unknown id, a credential in the conclusion."""
    asked = requests.select("request_id", "conclusion", F.array_sort(F.array_distinct("ids")).alias("ids"))
    known = asked.select("request_id", F.explode("ids").alias("memory_id")).join(entries.select("memory_id").distinct(), "memory_id", "left_semi")
    met = asked.join(known.groupBy("request_id").agg(F.count(F.lit(1)).alias("known")), "request_id", "left")
    reason = F.when(F.size("ids") < 2, "too_few").when(F.coalesce("known", F.lit(0)) < F.size("ids"), "unknown").when(T.has_credential(F.col("conclusion")), "credential").otherwise("ok")
    outcome = met.withColumn("reason", reason)
    rows = outcome.filter("reason = 'ok'").select("request_id", F.col("ids").alias("evidence_ids"), F.posexplode(T.chunks(F.col("conclusion"))).alias("pos", "text"), F.lit("model").alias("source"))
    return rows, outcome.select("request_id", "reason")
