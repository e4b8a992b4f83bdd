"""The inverted index as tables: postings, document frequencies, and IDF-weighted scores."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def postings(entries: DataFrame) -> DataFrame:
    """(token, memory_id), one row for each distinct token of an entry."""
    return entries.select("memory_id", F.explode(T.tokens(F.col("text"))).alias("token"))


def frequencies(entries: DataFrame) -> DataFrame:
    """(token, df)."""
    return postings(entries).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def matches(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, matches): postings that a query's words meet. A word meets as many as its document frequency, so no posting is joined."""
    asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return asked.join(frequencies(entries), "token").groupBy("query_id").agg(F.sum("df").alias("matches"))


#: Words of queries that are shared at once, queries that a batch is compared with at once, rows of a batch, and queries that are ranked at once.
WORDS, QUERIES, ROWS, RANKED = 500_000, 2048, 2048, 256
#: Pairs that are handed on at once, and weights that are added at once.
PAIRS = 500_000
#: A word whose queries and entries meet in over one of so many cells goes through a matrix product, with so many others at once.
DENSE, TOGETHER = 256, 256


def weights(entries: DataFrame, queries: DataFrame, mode: str = "ratio") -> DataFrame:
    """(query_id, words): the words of each query that some entry has, with their weights. ``queries``: (query_id, text), one row per chunk.

    ``ratio``: IDF over all IDF of the query, tokens that no entry has counting at the highest IDF; ``sum``: IDF alone; ``known``: as ratio,
    leaving unknown tokens out of the denominator. Document frequencies are counted within each task first.
    """
    total = entries.agg(F.count(F.lit(1)).alias("n"))
    asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    weighed = asked.join(frequencies(entries), "token", "left").crossJoin(F.broadcast(total))  # one row
    weighed = weighed.select("query_id", "token", "df", (F.col("times") * F.log(1 + F.col("n") / F.coalesce("df", F.lit(1)))).alias("idf"))
    known = F.col("df").isNotNull()
    whole = F.sum(F.when(known | F.lit(mode != "known"), F.col("idf")).otherwise(0.0))
    per = weighed.groupBy("query_id").agg(whole.alias("whole"), F.array_sort(F.collect_list(F.when(known, F.struct("token", "idf")))).alias("words"))
    share = (lambda w: w["idf"]) if mode == "sum" else (lambda w: w["idf"] / F.col("whole"))
    return per.select("query_id", F.transform("words", lambda w: F.struct(w["token"].alias("token"), share(w).alias("weight"))).alias("words")).filter(F.size("words") > 0)


def pair_scores(entries: DataFrame, queries: DataFrame, pairs: DataFrame, mode: str = "ratio") -> DataFrame:
    """(query_id, memory_id, score) of the given ``pairs`` (query_id, memory_id) only, as in ``scores``; 0 where no word is shared."""
    said = entries.select("memory_id", T.tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    met = pairs.select("query_id", "memory_id").distinct().join(weights(entries, queries, mode), "query_id").join(said, "memory_id")
    score = F.aggregate(F.filter("words", lambda w: F.array_contains("_t", w["token"])), F.lit(0.0), lambda s, w: s + w["weight"])
    return met.select("query_id", "memory_id", (score if mode == "sum" else F.least(score, F.lit(1.0))).alias("score"))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: half up, by the decimal form of the number."""
    ten = 10.0**digits
    t = x * ten
    out = np.floor(t + 0.5) / ten
    near = np.flatnonzero(np.abs(t - np.floor(t) - 0.5) < 1e-12 * np.maximum(np.abs(t), 1e3))
    if len(near):
        some, which = np.unique(x[near], return_inverse=True)
        exact = [float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in some.tolist()]
        out[near] = np.array(exact)[which]
    return out


def added(total: np.ndarray, low: np.ndarray, high: np.ndarray, query: np.ndarray, weight: np.ndarray, bounds: np.ndarray, entry: np.ndarray) -> None:
    """Add to ``total`` (query, entry) the weights of the words of a batch: a word has the places from ``low`` to ``high`` in ``query`` and ``weight``, and those
    between two of ``bounds`` in ``entry``. Words that fill much of the table go through matrix products, the others through lists of cells."""
    met, having = high - low, np.diff(bounds)
    dense = met * having * DENSE > total.size
    common = np.flatnonzero(dense)
    for x in range(0, len(common), TOGETHER):
        some = common[x : x + TOGETHER]
        left, right = np.zeros((len(total), len(some))), np.zeros((len(some), total.shape[1]))
        for w, g in enumerate(some.tolist()):
            left[query[low[g] : high[g]], w] = weight[low[g] : high[g]]
            right[w, entry[bounds[g] : bounds[g + 1]]] = 1
        total += left @ right
    sparse = np.repeat(np.flatnonzero(~dense), having[~dense])
    at = np.flatnonzero(np.repeat(~dense, having))
    times = met[sparse]
    ends = np.cumsum(times)
    flat, x = total.reshape(-1), 0
    while x < len(at):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + PAIRS, side="right")))
        n = times[x:y]
        place = np.repeat(low[sparse[x:y]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(flat, query[place] * total.shape[1] + np.repeat(entry[at[x:y]], n), weight[place])
        x = y


def scores(entries: DataFrame, queries: DataFrame, mode: str = "ratio", k: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, memory_id, score): matched weight of each query and entry that share a word; with ``k`` the query's best ``k`` only, with ``rank`` from 0.

    Entries stay where they are: the queries' words go to the tasks, at most about ``WORDS`` at once, and each task adds up its entries' scores and hands on its
    best ``k`` for each query. Scores count to nine digits where they are ranked; ties go to the smaller id. Without ``k`` the pairs of a block of queries and
    entries come by score at six digits, then query and place: equal numbers lie side by side, so that a written table of them is about half as large.
    ``digits``: scores that are handed on without ``k`` are rounded to so many.
    """
    spark = entries.sparkSession
    said = entries.select("memory_id", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    if k is not None:  # each task hands on k rows per query: as many tasks as the cluster runs, not as many as there are files
        said = said.coalesce(2 * spark.sparkContext.defaultParallelism)
    out, held, size = None, [], 0
    most_rows, most_queries = (ROWS, QUERIES) if k is not None else (2 * ROWS, max(QUERIES // 2, 1))

    def against(part: list) -> DataFrame:
        names = sorted({w.token for r in part for w in r.words})
        number = {t: i for i, t in enumerate(names)}
        pairs = sorted((number[w.token], q, w.weight) for q, r in enumerate(part) for w in r.words)
        shared = spark.sparkContext.broadcast((names, np.array([r.query_id for r in part], np.int64), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, ids, token, query, weight = shared.value
            words, key = pa.array(words, pa.string()), token * len(ids) + query  # in order
            best: dict[int, tuple] = {}

            def rows(at: np.ndarray, score: np.ndarray, memory: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(memory), pa.array(score)], names=["query_id", "memory_id", "score"])

            for batch in batches:
                for low in range(0, batch.num_rows, most_rows):
                    b = batch.slice(low, most_rows)
                    memory, lists = b.column(0).to_numpy(), b.column(1)
                    code = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy().astype(np.int64)
                    entry = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
                    order = np.lexsort((entry, code))
                    order = order[code[order] >= 0]
                    code, entry = code[order], entry[order]
                    new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
                    bounds, code = np.append(new, len(code)), code[new] * len(ids)
                    for first in range(0, len(ids), most_queries):
                        count = min(most_queries, len(ids) - first)
                        total = np.zeros((count, b.num_rows))
                        added(total, np.searchsorted(key, code + first), np.searchsorted(key, code + first + count), query - first, weight, bounds, entry)
                        if k is None:
                            if mode != "sum":
                                np.minimum(total, 1.0, out=total)
                            total = total.ravel()
                            cell = np.flatnonzero(total > 0)
                            order = np.rint(np.minimum(total[cell], 1e6) * 1e6).astype(np.int64) * total.size + cell
                            order.sort()
                            for x in range(0, len(order), PAIRS):
                                cell = order[x : x + PAIRS] % total.size
                                found = total[cell] if digits is None else rounded(total[cell], digits)
                                yield rows(cell // b.num_rows + first, found, memory[cell % b.num_rows])
                            continue
                        for low in range(0, count, RANKED):
                            part = total[low : low + RANKED]
                            place = first + low
                            near = part > 0
                            if mode != "sum":
                                np.minimum(part, 1.0, out=part)
                            ranked = np.round(part, 9)
                            if place in best:  # less than the k-th so far can't be among the first k
                                near &= ranked >= best[place][3][:, None]
                            elif k < b.num_rows:
                                near &= ranked >= np.partition(ranked, b.num_rows - k, axis=1)[:, b.num_rows - k, None]
                            at, e = np.nonzero(near)
                            found = (at, part[at, e], memory[e])
                            if place in best:
                                if not len(at):
                                    continue
                                found = tuple(map(np.concatenate, zip(best[place][:3], found)))
                            order = np.lexsort((found[2], -np.round(found[1], 9), found[0]))
                            at = found[0][order]
                            nth = np.arange(len(at)) - np.searchsorted(at, at)
                            least = np.zeros(len(part))
                            least[at[nth == k - 1]] = np.round(found[1][order][nth == k - 1], 9)
                            best[place] = (*(x[order][nth < k] for x in found), least)
            for first, (at, score, memory, _) in best.items():
                yield rows(at + first, score, memory)

        return said.mapInArrow(run, "query_id long, memory_id long, score double")

    for r in weights(entries, queries, mode).toLocalIterator():
        if held and size + len(r.words) > WORDS:
            out, held, size = against(held) if out is None else out.unionByName(against(held)), [], 0
        held.append(r)
        size += len(r.words)
    if held:
        out = against(held) if out is None else out.unionByName(against(held))
    if out is None:
        out = spark.createDataFrame([], "query_id long, memory_id long, score double")
    if k is None:
        return out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "memory_id"))
    return out.withColumn("rank", (rank - 1).cast("int")).filter(F.col("rank") < k)
