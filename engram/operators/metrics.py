"""Evaluation metrics over ranked lists, sets and distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit_at_k(ranked: DataFrame, gold: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Share of queries with a gold row among their first ``k``; optionally per type."""
    hit = ranked.filter(F.col("rank") <= k).join(gold.withColumn("_g", F.lit(1)), ["query_id", "memory_id"], "left")
    per = hit.groupBy("query_id", *([by] if by else [])).agg(F.max(F.coalesce("_g", F.lit(0))).alias("hit"))
    return per.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("queries"), F.avg("hit").alias("hit_rate"))


def recall_and_mrr(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: recall in the first ``k``, and the reciprocal rank of the first gold row."""
    size = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    found = ranked.filter(F.col("rank") <= k).join(gold, ["query_id", "memory_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return size.join(found, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.col("n_gold")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """From boolean ``predicted`` and ``gold``: counts, precision, recall, F1; null where undefined."""
    a = pairs.agg(F.count_if(F.col("predicted") & F.col("gold")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("gold")).alias("fp"), F.count_if(~F.col("predicted") & F.col("gold")).alias("fn"))
    zero = lambda c: F.nullif(c, F.lit(0))
    return a.withColumn("precision", F.col("tp") / zero(F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / zero(F.col("tp") + F.col("fn"))).withColumn("f1", 2 * F.col("tp") / zero(2 * F.col("tp") + F.col("fp") + F.col("fn")))


def gini(values: DataFrame, column: str) -> DataFrame:
    """Gini coefficient from the histogram of values, so that no row is ranked in a single partition."""
    h = values.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    rank_sum = F.sum(F.col("v") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2))
    return h.agg(rank_sum.alias("s"), F.sum(F.col("v") * F.col("c")).alias("t"), F.sum("c").alias("n")).select((2 * F.col("s") / (F.col("n") * F.nullif("t", F.lit(0.0))) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query: share of ``a``'s rows that are among ``b``'s."""
    hit = a.join(b.select("query_id", "memory_id").distinct().withColumn("_b", F.lit(1)), ["query_id", "memory_id"], "left")
    return hit.groupBy("query_id").agg((F.count("_b") / F.count(F.lit(1))).alias("fidelity"))


def binomial_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of ``b`` against ``c`` discordant pairs under equal odds: twice the binomial tail up to the lesser, 1 at most, and 1 without pairs.

    In log space: the tail relative to its largest term, a fold of ratios, times that term, a fold of logarithms. Terms too small for a double don't count.
    """
    n, k = b + c, F.least(b, c)
    up = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    largest = F.aggregate(up, F.lit(0.0), lambda s, j: s + F.log((n - k + j) / j))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * i / (n - i + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    tail = F.aggregate(F.reverse(up), start, step, lambda a: a["sum"])
    return F.when(b.isNull() | c.isNull(), F.lit(None)).otherwise(F.least(F.lit(1.0), 2 * F.exp(largest + F.log(tail) - n * float(math.log(2)))))


def paired(outcomes: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how often booleans ``a`` and ``b`` were both, only the one, only the other, or neither true, and the exact p of the unequal ones."""
    counts = outcomes.agg(*(F.count_if(x & y).alias(n) for n, x, y in (("both_true", F.col(a), F.col(b)), ("only_a", F.col(a), ~F.col(b)), ("only_b", ~F.col(a), F.col(b)), ("none_true", ~F.col(a), ~F.col(b)))))
    return counts.withColumn("p", binomial_p(F.col("only_a"), F.col("only_b")))
