"""Discrete codes of vectors: signs, the k strongest entries, and ternary codes of the k highest and k lowest; searches by popcounts.

A code is one or two bit planes, packed in longs of 32 bits like ``vector.sign_code``: a ternary code has the plane of entries that are set (+1 or
-1), then the plane of those that are +1. Ties between entries go to the smaller position; an entry among both the highest and the lowest is -1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once and not wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plane(bits: Column) -> Column:
    """An array of booleans packed, the first of 32 in the highest bit."""
    words = F.sequence(F.lit(0), F.ceil(F.size(bits) / 32).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 32 + 1, F.lit(32)), F.lit(0).cast("bigint"), lambda s, x: s * 2 + x.cast("bigint")))


def _first(a: Column, value, k: int) -> Column:
    """Whether each entry is among the ``k`` least of ``value(entry)``."""
    placed = F.transform(a, lambda x, i: F.struct(value(x).alias("v"), i.alias("i")))
    return _once(placed, lambda p: _once(F.element_at(F.slice(F.array_sort(p), 1, k), -1), lambda last: F.transform(p, lambda x: x <= last)))


def strongest(a: Column, k: int) -> Column:
    """Code of the ``k`` entries of the largest absolute value."""
    return F.when(a.isNotNull() & (F.size(a) > 0), _once(_first(a, lambda x: -F.abs(x.cast("double")), k), _plane))


def ternary(a: Column, k: int) -> Column:
    """Code of the ``k`` highest entries (+1) and the ``k`` lowest (-1)."""
    low, high = _first(a, lambda x: x.cast("double"), k), _first(a, lambda x: -x.cast("double"), k)
    both = _once(F.struct(high.alias("h"), low.alias("l")), lambda s: F.concat(_plane(F.zip_with(s["h"], s["l"], lambda h, lo: h | lo)), _plane(F.zip_with(s["h"], s["l"], lambda h, lo: h & ~lo))))
    return F.when(a.isNotNull() & (F.size(a) > 0), both)


def _popcounts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _apart(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Less the number of common bits."""
    d = np.zeros((len(x), len(q)), np.int32)
    for w in range(x.shape[1]):
        d -= _popcounts(x[:, w, None] & q[None, :, w])
    return d


def _against(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Less the dot product of ternary codes: entries set in both, less twice those of which one is +1 and one -1."""
    d, half = np.zeros((len(x), len(q)), np.int32), x.shape[1] // 2
    for w in range(half):
        both = x[:, w, None] & q[None, :, w]
        d -= _popcounts(both)
        d += 2 * _popcounts(both & (x[:, half + w, None] ^ q[None, :, half + w])).astype(np.int32)
    return d


def nearest_by(items: DataFrame, queries: DataFrame, k: int, kind: str, *, block: int = 16_384) -> DataFrame:
    """(query_id, memory_id, score, rank): each query's ``k`` items of the highest ``overlap`` or ``ternary`` score of their ``code``, ties by id."""
    found = V._search(items, queries, "code", k, {"overlap": _apart, "ternary": _against}[kind], None, block)
    return found.select("query_id", "memory_id", (-F.col("d")).cast("int").alias("score"), "rank")


def agreement(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: queries, recall (mean share of the exact first ``k`` that are found among the first ``k``) and first (share of equal first rows)."""
    a = found.filter(F.col("rank") < k).select("query_id", "memory_id", F.col("rank").alias("_a"))
    b = exact.filter(F.col("rank") < k).select("query_id", "memory_id", F.col("rank").alias("_b"))
    per = b.join(a, ["query_id", "memory_id"], "left").groupBy("query_id").agg((F.count("_a") / F.lit(k)).alias("share"), F.max(((F.col("_a") == 0) & (F.col("_b") == 0)).cast("double")).alias("same"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("share").alias("recall"), F.avg(F.coalesce("same", F.lit(0.0))).alias("first"))
