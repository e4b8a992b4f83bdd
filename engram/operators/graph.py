"""Graph operators: components of similarity edges, lineage closure, clusters. Iterations are cut to reliable storage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written


#: Members of a slice that are compared with a slice of visitors at once, and rows that go visiting at once.
STRIP = 256

#: Iterations are cut to tables in the shared folder.
checkpointed = written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(memory_id, cluster): cluster is the smallest id of the component; nodes without edges are their own."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = checkpointed(both)
    now = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("memory_id"), F.least("a", "m").alias("cluster")))
    while True:
        near = both.join(now.select(F.col("memory_id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("memory_id")).agg(F.min("cluster").alias("m"))
        step = now.join(near, "memory_id").select("memory_id", F.col("cluster").alias("was"), F.least("cluster", "m").alias("cluster"))
        step = step.join(now.select(F.col("memory_id").alias("cluster"), F.col("cluster").alias("far")), "cluster", "left")
        step = checkpointed(step.select("memory_id", "was", F.least("cluster", "far").alias("cluster")))
        now = step.select("memory_id", "cluster")
        if not step.filter("cluster <> was").take(1):
            break
    return nodes.select("memory_id").join(now, "memory_id", "left").select("memory_id", F.coalesce("cluster", "memory_id").alias("cluster"))


def similar_pairs(vectors: DataFrame, theta: float, k: int | None = None, *, pivots: int = 256, block: int = 2048, forest: bool = False) -> DataFrame:
    """(a, b, sim), a < b: all pairs with a cosine of at least ``theta`` (above 0); ``k`` keeps each row's best ``k`` only.

    Exact and without a cross join. ``pivots`` rows, chosen by id hash, split the sphere into cells; a row is at home in the cell of
    its nearest pivot and visits another cell only if its angle to that pivot is within the cell's radius plus the
    angle of ``theta``, without which no member can be near enough. In a cell, slices of members meet slices of visitors,
    ``block`` rows each at most on average, in matrix products of ``STRIP`` members; a hot cell is dealt out into more slices. The driver
    sees the pivots and one row of figures per cell. Rows without a direction (null, zero) have no pairs. With ``forest`` two slices hand on, instead of their
    pairs, (smallest id, id) for each component that they make: the same components over all, at most a row for each row of a slice.
    """
    if theta <= 0:
        raise ValueError("theta must be above 0")
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "a long, b long, sim double")
    v = vectors.select("memory_id", "embedding").filter("embedding is not null and exists(embedding, x -> x <> 0)")
    chosen = v.orderBy(F.xxhash64("memory_id"), "memory_id").limit(pivots).collect()
    if not chosen:
        return empty
    centres = spark.sparkContext.broadcast(_unit(np.array([r.embedding for r in chosen], float)))

    def angles(b: pa.RecordBatch) -> np.ndarray:
        x = np.asarray(b.column("embedding").flatten(), float).reshape(b.num_rows, -1)
        return np.arccos(np.clip(_unit(x) @ centres.value.T, -1, 1))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, 4 * STRIP) for b in batches for low in range(0, b.num_rows, 4 * STRIP)):
            if b.num_rows:
                d = angles(b)
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(d[np.arange(len(home)), home])], names=["memory_id", "embedding", "cell", "angle"])

    kind = v.schema["embedding"].dataType
    homes = checkpointed(v.mapInArrow(settle, T.StructType([*v.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])))
    reach = np.full(len(chosen), -1.0)
    sizes = {}
    for r in homes.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        reach[r.cell], sizes[r.cell] = r.radius + np.arccos(min(theta, 1.0)) + 1e-6, r.n

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, STRIP) for b in batches for low in range(0, b.num_rows, STRIP)):  # a row may visit every cell
            if b.num_rows:
                home = np.asarray(b.column("cell"))
                goes = angles(b) <= reach
                goes &= np.arange(len(reach)) > home[:, None]  # of two cells, the later one is visited
                goes[np.arange(len(home)), home] = True
                row, cell = np.nonzero(goes)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("memory_id").take(at), b.column("embedding").take(at), pa.array(cell, pa.int32()), pa.array(cell == home[row])], names=["memory_id", "embedding", "cell", "own"])

    visitors = homes.mapInArrow(visit, T.StructType([T.StructField("memory_id", T.LongType()), T.StructField("embedding", kind), T.StructField("cell", T.IntegerType()), T.StructField("own", T.BooleanType())]))
    coming = {r.cell: r.n for r in visitors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame([(c, -(-n // block), -(-coming[c] // block)) for c, n in sizes.items()], "cell int, slices int, chunks int")  # a row per pivot
    part = lambda of: F.pmod(F.xxhash64("memory_id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = homes.join(F.broadcast(plan), "cell").select("memory_id", "embedding", "cell", part("slices").alias("i"), every("chunks").alias("j"))
    right = visitors.join(F.broadcast(plan), "cell").select("memory_id", "embedding", "own", "cell", every("slices").alias("i"), part("chunks").alias("j"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        def unit(t: pa.Table) -> np.ndarray:
            e = np.asarray(t.column("embedding").combine_chunks().flatten(), float).reshape(t.num_rows, -1)
            return e / (np.linalg.norm(e, axis=1, keepdims=True) + 1e-8)

        ids, other = np.asarray(x.column("memory_id"), np.int64), np.asarray(y.column("memory_id"), np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if x.num_rows and y.num_rows:
            u, v, own = unit(x), unit(y).T, np.asarray(y.column("own"))
            near = np.zeros((len(ids), len(other)) if forest else (0, 0), bool)
            for low in range(0, len(ids), STRIP):
                sims = u[low : low + STRIP] @ v
                if forest:
                    near[low : low + STRIP] = sims >= theta
                    continue
                i, j = np.nonzero(sims >= theta)
                a, b, sim = ids[low + i], other[j], sims[i, j]
                keep = np.where(own[j], a < b, a != b)  # members of one cell meet twice
                a, b = a[keep], b[keep]
                found.append((np.minimum(a, b), np.maximum(a, b), sim[keep]))
            if forest:
                a, b = _stars(near, ids, other)
                found.append((a, b, np.full(len(a), theta)))
        return pa.table(list(map(np.concatenate, zip(*found))), names=["a", "b", "sim"])

    key = ["cell", "i", "j"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "a long, b long, sim double")
    if k is None:
        return pairs
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "sim").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "sim"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("sim"), "y"))
    return both.withColumn("r", rank).filter(F.col("r") <= k).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim").dropDuplicates(["a", "b"])


def _stars(near: np.ndarray, ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id, id) of the components of the two-sided graph ``near``. Every row and column is looked at once, so a component of any shape takes
    time by the matrix's size."""
    row_seen, col_seen = ~near.any(axis=1), ~near.any(axis=0)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for seed in range(len(ids)):
        if row_seen[seed]:
            continue
        rows, held = np.array([seed]), []
        row_seen[seed] = True
        while len(rows):
            cols = np.flatnonzero(near[rows].any(axis=0) & ~col_seen)
            col_seen[cols] = True
            held += [ids[rows], other[cols]]
            rows = np.flatnonzero(near[:, cols].any(axis=1) & ~row_seen)
            row_seen[rows] = True
        all_ids = np.unique(np.concatenate(held))
        a.append(np.full(len(all_ids) - 1, all_ids[0]))
        b.append(all_ids[1:])
    return np.concatenate(a), np.concatenate(b)


def later_neighbours(pairs: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(a, b, sim, rank, ts): of ``pairs`` (a < b) each row's ``k`` nearest among those that follow it when entries go from newest to oldest
    (ties by id); a is the newer one, ts its time. Pairs of ids without an entry fall away."""
    x, y = (entries.select(F.col("memory_id").alias(i), F.col("ts").alias(t)) for i, t in (("a", "_s"), ("b", "_t")))
    met = pairs.join(x, "a").join(y, "b").withColumn("_turned", F.col("_t") > F.col("_s"))
    first, second = (F.when(F.col("_turned"), F.col(p)).otherwise(F.col(q)) for p, q in (("b", "a"), ("a", "b")))
    met = met.select(first.alias("a"), second.alias("b"), "sim", F.greatest("_s", "_t").alias("ts"), F.least("_s", "_t").alias("_o"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), F.desc("_o"), "b"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_o")


def conflicts(pairs: DataFrame, entries: DataFrame, k: int = 5) -> DataFrame:
    """``later_neighbours`` whose texts differ; an empty and a missing text are equal. Texts move as digests."""
    s = entries.select("memory_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_x"))
    near = later_neighbours(pairs, entries, k)
    near = near.join(s.select(F.col("memory_id").alias("a"), "_x"), "a").join(s.select(F.col("memory_id").alias("b"), F.col("_x").alias("_y")), "b")
    return near.filter("_x <> _y").drop("_x", "_y")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def clusters(vectors: DataFrame, theta: float) -> DataFrame:
    """(memory_id, cluster): components of the pairs at ``theta``. Rows of equal vectors are one node, so that copies are
    never expanded into pairs."""
    v = vectors.select("memory_id", "embedding")
    # A zero vector has no direction: its rows stay alone.
    nodes = v.filter("embedding is not null and exists(embedding, x -> x <> 0)").groupBy("embedding").agg(F.min("memory_id").alias("memory_id"))
    named = components(nodes, similar_pairs(nodes, theta, forest=True)).join(nodes, "memory_id").select("embedding", "cluster")
    return v.join(named, "embedding", "left").select("memory_id", F.coalesce("cluster", "memory_id").alias("cluster"))


def newest_in_cluster(clusters: DataFrame, entries: DataFrame) -> DataFrame:
    """(cluster, size, newest)."""
    return clusters.join(entries.select("memory_id", "ts"), "memory_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("ts", "memory_id")).alias("_m")).select("cluster", "size", F.col("_m.memory_id").alias("newest"))


def ancestry(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(memory_id, successor, depth): every row that a chain of ``superseded_by`` reaches. Paths double each round."""
    step = links.filter("superseded_by is not null").select("memory_id", F.col("superseded_by").alias("successor"), F.lit(1).alias("depth"))
    reach = checkpointed(step)
    for _ in range(rounds):
        more = reach.alias("x").join(reach.alias("y"), F.col("x.successor") == F.col("y.memory_id")).select("x.memory_id", "y.successor", (F.col("x.depth") + F.col("y.depth")).alias("depth"))
        wider = checkpointed(reach.unionByName(more).groupBy("memory_id", "successor").agg(F.min("depth").alias("depth")))
        if wider.count() == reach.count():
            return wider
        reach = wider
    return reach


def pool_resolve(hits: DataFrame, clusters: DataFrame, entries: DataFrame, top: int = 3) -> DataFrame:
    """Per query: of its best ``top`` hits, if a cluster holds two or more, the newest of those; else the best hit."""
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "memory_id"))).filter(F.col("r") <= top)
    best = best.join(clusters, "memory_id").join(entries.select("memory_id", "ts"), "memory_id")
    group = best.groupBy("query_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lead"), F.max(F.struct("ts", "memory_id")).alias("m"), F.min(F.struct("r", "memory_id")).alias("f"))
    order = Window.partitionBy("query_id").orderBy((F.col("n") < 2), "lead")
    return group.withColumn("o", F.row_number().over(order)).filter("o = 1").select("query_id", F.when(F.col("n") >= 2, F.col("m.memory_id")).otherwise(F.col("f.memory_id")).alias("memory_id"), (F.col("n") >= 2).alias("resolved"))
