"""Embedding whitening: exact integer sums, a second pass of centred outer products, one symmetric eigenproblem.

Each usable vector becomes whole numbers x = floor(64 c) + 1,000,000. The statistics are those of the distinct x
vectors, so copies, however many, count once; they are removed by an aggregation that combines within each task first. Pass one
sums x exactly; pass two subtracts the mean (its whole part in integers, the rest in double) and sums outer products by
matrix multiplication, one matrix for each task, merged by treeAggregate. What reaches the driver is one sum and one
matrix of dims x dims, whatever the number of rows; ``MOST_DIMS`` bounds it. The projection (dims x components) is broadcast.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinite entry are dropped; so are vectors of another
length than the most frequent one (of equally frequent lengths the longest). Entries beyond +-2^46 count as that bound. Rows of null or
repeated ids are kept as they are. Components end at the rank: eigenvalues under 1e-12 of the largest can't be scaled to unit
variance, so a table of one distinct vector has none and gives no rows, as an empty table. A deviation that doesn't fit in a long is null.
Each component's largest entry is positive (of equally large ones the first).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shielded, table, tidy

SCALE, SHIFT, COMPONENTS, MOST_DIMS = 64, 1_000_000, 16, 4096
_BOUND, _RANK, _BLOCK = float(2**52), 1e-12, 1 << 20


class Model(NamedTuple):
    """What the fit list gives: its size, exact sums, the projection (dims x components), shares of variance, and how far
    the covariance of the projected fit list is from the identity."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole(vector: Column) -> Column:
    """The vector in whole numbers."""
    scaled = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-_BOUND)), F.lit(_BOUND))
    return F.transform(vector, lambda c: F.floor(scaled(c)) + F.lit(SHIFT).cast("long"))


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector holds finite numbers only and has the most frequent length, with x as column ``x``."""
    finite = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    lengths = rows.groupBy(F.size(vec_col).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = lengths[0].dims if lengths else 0
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} entries: at most {MOST_DIMS} are whitened, as each task holds a square matrix")
    return rows.filter(F.size(vec_col) == dims).withColumn("x", whole(F.col(vec_col)))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The column x in blocks of rows of bounded size."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            step = max(1, _BLOCK // x.shape[1])
            for i in range(0, len(x), step):
                yield x[i : i + step]


def _one_row(payload: bytes, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "payload": pa.array([payload], pa.binary())})


_PARTIAL = "n long, payload binary"


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sum of each entry, exact: high and low halves are summed apart, then as unbounded integers."""

    @tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for x in _matrices(batches):
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield _one_row(np.concatenate([high, low]).astype("<i8").tobytes(), n)

    def add(total: tuple, row) -> tuple:
        high, low = np.frombuffer(bytes(row.payload), "<i8").reshape(2, -1).astype(object)
        return merge(total, (row.n, high * 2**32 + low))

    def merge(a: tuple, b: tuple) -> tuple:
        return (a[0] + b[0], b[1] if a[1] is None else a[1] if b[1] is None else a[1] + b[1])

    n, sums = fit.select("x").mapInArrow(partial, _PARTIAL).rdd.treeAggregate((0, None), add, merge)
    return n, [] if sums is None else [int(s) for s in sums]


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole part and rest in [0, 1)."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def second_moments(fit: DataFrame, n: int, sums: list[int], projection: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of outer products of the centred rows, or of their projections."""
    base, rest = _centre(n, sums)
    shared = fit.sparkSession.sparkContext.broadcast(projection)

    @tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = outer = None
        for x in _matrices(batches):
            c = (x - base).astype(np.float64) - rest
            if shared.value is not None:
                c = c @ shared.value
            one, two = c.sum(0), c.T @ c
            ones, outer = (one, two) if outer is None else (ones + one, outer + two)
        if outer is not None:
            yield _one_row(np.vstack([ones, outer]).astype("<f8").tobytes(), 0)

    def add(total, row):
        part = np.frombuffer(bytes(row.payload), "<f8")
        return part if total is None else total + part

    def merge(a, b):
        return b if a is None else a if b is None else a + b

    flat = fit.select("x").mapInArrow(partial, _PARTIAL).rdd.treeAggregate(None, add, merge)
    k = len(sums) if projection is None else projection.shape[1]
    both = flat.reshape(k + 1, k)
    return both[0], both[1:]


def fit(vectors: DataFrame, vec_col: str, components: int = COMPONENTS) -> tuple[DataFrame, Model | None]:
    """The usable rows and the model of their distinct x vectors; no model where there is nothing to scale."""
    rows = usable(vectors, vec_col)
    distinct = cut(rows.select("x").distinct())
    n, sums = exact_sums(distinct)
    if not n:
        return rows, None
    covariance = second_moments(distinct, n, sums)[1] / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > max(values[0], 0.0) * _RANK).sum()))
    if not k:
        return rows, None
    axes = axes[:, :k] * np.where(np.take_along_axis(axes[:, :k], np.abs(axes[:, :k]).argmax(0)[None], 0) < 0, -1.0, 1.0)
    projection = axes / np.sqrt(values[:k])
    ones, outer = second_moments(distinct, n, sums, projection)
    off = outer / n - np.outer(ones / n, ones / n) - np.eye(k)
    return rows, Model(n, sums, projection, values[:k] / np.trace(covariance), float(np.abs(off).max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the sum over entries of (n x - S)^2, exact; None beyond a long."""
    base, _ = _centre(n, sums)
    rest = [s % n for s in sums]
    most = (int(np.abs(x - base).max(initial=0)) + 1) * n
    if x.shape[1] * most * most < 2**63:
        away = (x - base) * np.int64(n) - np.array(rest, np.int64)
        return (away * away).sum(1).tolist()
    away = (x - base).astype(object) * n - np.array(rest, object)
    return [int(s) if s < 2**63 else None for s in (away * away).sum(1)]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component: the id, component, n, deviation, whitened, explained, identity_error."""
    vectors, new, _ = shielded(vectors)
    rows, model = fit(vectors, new[vec_col], components)
    kind = rows.schema[new[id_col]].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, _, explained, error = model
    base, rest = _centre(n, sums)
    shared = rows.sparkSession.sparkContext.broadcast(model.projection)
    k = len(explained)

    @tidy
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrices([batch]):
                ids = batch.column(0).slice(at, len(x))
                at += len(x)
                w = ((x - base).astype(np.float64) - rest) @ shared.value
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(each), n, np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col(new[id_col]).alias("id"), "x").mapInArrow(project, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every usable embedding, whitened."""
    return whitened(table(spark, sf_dir, "embeddings"))
