"""Pattern completion without a dense weight matrix: W s is the sum over patterns of p (p . s).

Patterns stay where they lie. States, a bounded block at a time, go to every task, which sums p (p . s) over its own
patterns; the shuffle carries one row of sums per task and state, however many patterns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recall import top


#: Patterns that a task compares with a block of states at once.
ROWS = 1024


def signs(embedding: Column) -> Column:
    """1 or -1 per dimension; zero counts as -1."""
    return F.transform(embedding, lambda x: F.when(x > 0, 1).otherwise(-1))


def _blocks(states: DataFrame, block: int) -> Iterator[list]:
    held = []
    for r in states.select("query_id", "compartment", "code").toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def _with_compartment(df: DataFrame) -> DataFrame:
    return df if "compartment" in df.columns else df.withColumn("compartment", F.lit(0).cast("long"))


def _each(patterns: DataFrame, states: DataFrame, block: int, schema: str, visit) -> DataFrame:
    """``visit(patterns, ids, states, carried)`` over the batches of a task, for each compartment; unites what the tasks hand on."""
    spark, out = patterns.sparkSession, None
    patterns = _with_compartment(patterns).filter("code is not null")
    for part in _blocks(_with_compartment(states), block):
        places = np.array([r.compartment for r in part], np.int64)
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in part], np.int64), places, np.array([r.code for r in part], float)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, places, codes = shared.value
            carried: dict = {}
            for b in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
                p = np.asarray(b.column("code").flatten(), float).reshape(b.num_rows, -1)
                ids, at = (np.asarray(b.column(c), np.int64) for c in ("memory_id", "compartment"))
                for c in np.unique(at):
                    mine = places == c
                    if mine.any():
                        carried[c] = visit(p[at == c], ids[at == c], codes[mine], carried.get(c))
            for c, (held, other) in carried.items():
                mine = np.flatnonzero(places == c)
                columns = [pa.array(names[mine]), pa.array(places[mine]), pa.array(list(held)) if held.ndim > 1 else pa.array(held)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(other)] if other is not None else []), names=[x.split()[0] for x in schema.split(", ")])

        found = patterns.select("memory_id", "compartment", "code").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def recall_step(patterns: DataFrame, states: DataFrame, block: int = 1024) -> DataFrame:
    """(query_id, compartment, code): one synchronous update of each state (query_id[, compartment], code) by the patterns
    (memory_id[, compartment], code) of its compartment; zero counts as 1."""

    def visit(p, ids, s, carried):
        field = (p @ s.T).T @ p
        return (field if carried is None else carried[0] + field), None

    sums = _each(patterns, states, block, "query_id long, compartment long, f array<double>", visit)
    total = sums.select("query_id", "compartment", F.posexplode("f").alias("i", "f")).groupBy("query_id", "compartment", "i").agg(F.sum("f").alias("f"))
    code = F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda x: F.when(x.f >= 0, 1).otherwise(-1))
    return total.groupBy("query_id", "compartment").agg(code.alias("code"))


def settle(patterns: DataFrame, states: DataFrame, rounds: int = 10) -> DataFrame:
    """Updates until nothing changes, at most ``rounds``; (query_id, compartment, code)."""
    from .graph import checkpointed

    states = _with_compartment(states)
    for _ in range(rounds):
        new = checkpointed(recall_step(patterns, states))
        changed = new.join(states.select("query_id", "compartment", F.col("code").alias("was")), ["query_id", "compartment"]).filter("code <> was").take(1)
        states = new
        if not changed:
            break
    return states


def best_match(patterns: DataFrame, states: DataFrame, block: int = 1024) -> DataFrame:
    """(query_id, compartment, memory_id, overlap): each state's most similar pattern of its compartment, ties to the smallest id."""

    def visit(p, ids, s, carried):
        order = np.argsort(ids, kind="stable")
        p, ids = p[order], ids[order]
        m = p @ s.T / p.shape[1]
        first = m.argmax(axis=0)  # of equal ones the smallest id
        best, who = m[first, np.arange(len(s))], ids[first]
        if carried is None:
            return best, who
        better = (best > carried[0]) | ((best == carried[0]) & (who < carried[1]))
        return np.where(better, best, carried[0]), np.where(better, who, carried[1])

    found = _each(patterns, states, block, "query_id long, compartment long, overlap double, memory_id long", visit)
    best = F.max(F.struct("overlap", (-F.col("memory_id")).alias("m")))
    return found.groupBy("query_id", "compartment").agg(best.alias("b")).select("query_id", "compartment", (-F.col("b.m")).alias("memory_id"), "b.overlap")


def recall_all(patterns: DataFrame, cues: DataFrame, k: int = 3, rounds: int = 10) -> DataFrame:
    """Each cue settles in every compartment; (query_id, compartment, memory_id, overlap, rank) of the ``k`` compartments whose
    best pattern overlaps its settled state most."""
    places = patterns.select("compartment").distinct().agg(F.collect_set("compartment").alias("_c"))  # as many as the store has compartments
    states = cues.select("query_id", "code").crossJoin(F.broadcast(places)).select("query_id", F.explode("_c").alias("compartment"), "code")
    found = best_match(patterns, settle(patterns, states, rounds))
    return top(found, [F.desc("overlap"), F.col("compartment")], k, ["query_id"])
