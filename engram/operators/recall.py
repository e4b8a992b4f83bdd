"""Hybrid recall: a dense and a lexical rank list per query, joined by reciprocal-rank fusion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import nearest
from . import lexical

POOL, RRF = 200, 60


def dense_list(vectors: DataFrame, query_vectors: DataFrame, pool: int = POOL) -> DataFrame:
    """(query_id, memory_id, sim, dense_rank), ranks from 0. A query of several chunks scores its best chunk."""
    return nearest(vectors, query_vectors, pool).withColumnRenamed("rank", "dense_rank")


def lexical_list(entries: DataFrame, queries: DataFrame, pool: int = POOL, mode: str = "ratio") -> DataFrame:
    """(query_id, memory_id, lex, lex_rank); rows without a match never enter."""
    # Ranks are by the score at nine digits: sums of the same terms may differ in the last bits with their order.
    return lexical.scores(entries, queries, mode, pool).withColumnsRenamed({"score": "lex", "rank": "lex_rank"})


def fuse(dense: DataFrame, lex: DataFrame, constant: int = RRF) -> DataFrame:
    """(query_id, memory_id, sim, lex, rrf, fused_rank): sum of 1 / (constant + rank); ties keep the dense list's order, then the lexical one's."""
    both = dense.join(lex, ["query_id", "memory_id"], "full_outer")
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", part("dense_rank") + part("lex_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), F.col("dense_rank").asc_nulls_last(), F.col("lex_rank").asc_nulls_last())
    return scored.withColumn("fused_rank", F.row_number().over(order))


def eligible(entries: DataFrame, *, superseded: bool = False, compartment: str | None = None) -> DataFrame:
    kept = entries if superseded else entries.filter("superseded_by is null")
    return kept if compartment is None else kept.filter(F.array_contains("tags", f"comp:{compartment}"))


def recall(entries: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, top_k: int = 5, *, superseded: bool = False, compartment: str | None = None, prefilter: bool = False, pool: int = POOL) -> DataFrame:
    """The flagship query. By default eligibility is tested after fusion, as the pools are cut first; ``prefilter``
    tests it before, so that a small compartment isn't crowded out."""
    allowed = eligible(entries, superseded=superseded, compartment=compartment)
    if prefilter:
        entries, vectors = allowed, vectors.join(allowed.select("memory_id"), "memory_id", "left_semi")
    fused = fuse(dense_list(vectors, query_vectors, pool), lexical_list(entries, queries, pool))
    kept = fused.join(allowed.select("memory_id", "ts"), "memory_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("fused_rank"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def touched(entries: DataFrame, hits: DataFrame, now: float) -> DataFrame:
    """Entries after a recall: each returned row is rehearsed once per query that returned it."""
    log = hits.groupBy("memory_id").agg(F.count(F.lit(1)).alias("_n"))
    hit = F.col("_n").isNotNull()
    out = entries.join(log, "memory_id", "left")
    out = out.withColumn("last_accessed", F.when(hit, F.lit(now)).otherwise(F.col("last_accessed"))).withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0)))
    return out.select(*entries.columns)


def top(df: DataFrame, by: list[Column], k: int, part: list[str]) -> DataFrame:
    """The first ``k`` rows of each part."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*by))).filter(F.col("rank") <= k)


def reranked(hits: DataFrame, entries: DataFrame, queries: DataFrame, scorer, top_k: int = 5, pool: int = 10) -> DataFrame:
    """The first ``pool`` hits (query_id, memory_id, rank) of each query in the order of ``scorer(query text, entry text)``, a Column
    or pandas_udf; equal scores (at nine digits) keep their rank. Only the pool's texts are joined."""
    met = hits.filter(F.col("rank") <= pool).select("query_id", "memory_id", F.col("rank").alias("was"))
    met = met.join(entries.select("memory_id", "text"), "memory_id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    return top(met.withColumn("score", F.round(scorer(F.col("_q"), F.col("text")), 9)).drop("_q", "text"), [F.desc("score"), F.col("was")], top_k, ["query_id"])


def months(first: str, last: str) -> tuple[float, float]:
    """Start of the month ``first`` and 31 days after the start of ``last`` (``YYYY-MM``), in seconds UTC."""
    a, b = (dt.datetime.strptime(m, "%Y-%m").replace(tzinfo=dt.timezone.utc).timestamp() for m in (first, last))
    return a, b + 31 * 86400.0
