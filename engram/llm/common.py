"""What the training-data operators share: shared-folder checkpoints, Arrow access, summed arrays."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. One of our own only where none is set and driver and executors are one
    process (tests); on a cluster without a shared folder: an error, since executors can't share a local one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="engram-")
    sc.setCheckpointDir(named)
    return named


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours, if the session still lives."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone: the cluster's own clean-up of the shared folder is left
        pass


@functools.lru_cache(maxsize=4)
def _own_folder(application: str, base: str) -> str:
    folder = f"{base.rstrip('/')}/engram-llm-{application}-{uuid.uuid4().hex[:8]}"
    spark = SparkSession.getActiveSession()
    if spark is not None:
        atexit.register(_delete, spark, folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends."""
    return f"{_own_folder(spark.sparkContext.applicationId, checkpoint_dir(spark))}/{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, *, spent: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there: a lost executor costs no recomputation. ``spent``: nothing else
    reads what was shuffled for it, so those files go at once.

    A table rather than checkpoint(): a checkpointed DataFrame keeps the size its plan was estimated at, and over many rounds
    of joins that estimate, a product, grows so long that multiplying it takes seconds.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession)
    before = spark.conf.get(SPENT, None)
    try:
        if spent:
            spark.conf.set(SPENT, "true")
        df.write.parquet(folder)
    finally:
        if spent and before is not None:
            spark.conf.set(SPENT, before)
        elif spent:
            spark.conf.unset(SPENT)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``tables``, which nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._folder)


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` under column names that clash with nothing, the new name of each column, and the way back."""
    prefix = "engram_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    new = {c: f"{prefix}{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new, lambda df: df.select(*(F.col(n).alias(c) for c, n in new.items()))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as empty text, so it is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a column, null as empty."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Texts of a column in UTF-8, null as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def runs(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to about ``most``; a larger row stands alone."""
    start, total, end = 0, 0, 0
    for end, size in enumerate(sizes):
        if total and total + size > most:
            yield start, end
            start, total = end, 0
        total += size
        end += 1
    if end > start:
        yield start, end


def parts(batch: pa.RecordBatch, name: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of the text column ``name``; a longer text stands alone."""
    at = _bytes_of(batch.column(name))[1]
    for a, b in runs(np.diff(at).tolist(), most):
        yield batch.slice(a, b - a)
    if not batch.num_rows:
        yield batch


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow; when a task ends, freed memory goes back to the system, as workers live on."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xorshift and multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[np.frombuffer(BLANKS.encode(), np.uint8)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: A value for each byte, none for blanks; longer words than _LONG bytes are hashed as a whole.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[_IS_BLANK] = 0
_LONG, _STEP = 512, 1 << 16


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, one for each place of a step."""
    base, out = 0xD1342543DE82EF95, []
    for x in (base, pow(base, -1, 1 << 64)):
        a = np.full(_STEP + _LONG, x, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts in them (n + 1 places); null as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def _hashes_of_step(d: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``d`` that begin at ``start``."""
    import xxhash

    up, down = _powers()
    if len(d) > len(up):  # a very long word: one by one
        ends = [int(x) for x in [*start[1:], len(d)]]
        parts = [d[s:e][: int(k[0]) if len(k := np.flatnonzero(_IS_BLANK[d[s:e]])) else None] for s, e in zip(start.tolist(), ends, strict=True)]
        sums = [(_BYTE[w] * up[: len(w)]).sum(dtype=np.uint64) if len(w) <= _LONG else 0 for w in parts]
        h = mix64(np.array(sums, np.uint64))
        for i, w in enumerate(parts):
            if len(w) > _LONG:
                h[i] = xxhash.xxh3_64_intdigest(w.tobytes())
        return h
    value = _BYTE[d]
    value *= up[: len(d)]
    h = mix64(np.add.reduceat(value, start) * down[start])
    size = np.diff(start, append=len(d))
    for i in np.flatnonzero(size > _LONG).tolist():
        w = d[start[i] : start[i] + size[i]]
        blank = np.flatnonzero(_IS_BLANK[w])
        w = w[: blank[0]] if len(blank) else w
        if len(w) > _LONG:
            h[i] = xxhash.xxh3_64_intdigest(w.tobytes())
    return h


def word_hashes(column: pa.Array, *, fold: bool = False, step: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs between blanks) of a column's texts, and each row's bounds in them. ``fold``: A-Z as a-z.

    The bytes are hashed in steps that end at a blank or a row's end, so the work arrays stay small whatever a text's length: a
    word's hash is the mixed sum of its bytes' values times powers, taken from a running sum that no word has to be cut out for.
    """
    data, at = _bytes_of(column)
    out, starts_at, lo, n = [], [], 0, len(data)
    while lo < n:
        hi = min(n, lo + step)
        if hi < n and not _IS_BLANK[data[hi - 1]]:  # on to the end of the word
            row = int(at[np.searchsorted(at, hi)])
            while hi < row:
                gap = np.flatnonzero(_IS_BLANK[data[hi : min(row, hi + _STEP)]])
                hi = hi + int(gap[0]) if len(gap) else min(row, hi + _STEP)
                if len(gap):
                    break
        d = data[lo:hi]
        if fold:
            d = _FOLD[d]
        blank = _IS_BLANK[d]
        edge = np.empty(len(d), bool)  # a blank or a row's start before each place
        edge[0] = True
        edge[1:] = blank[:-1]
        a, b = np.searchsorted(at, (lo, hi))
        edge[at[a:b] - lo] = True
        edge &= ~blank
        start = np.flatnonzero(edge)
        if len(start):
            out.append(_hashes_of_step(d, start))
            starts_at.append(start + lo)
        lo = hi
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(out), np.searchsorted(np.concatenate(starts_at), at).astype(np.int64)


def summed(df: DataFrame, dtype: str, fan_in: int = 64, total: str = "<i8", decode: Callable = bytes) -> dict[int, np.ndarray]:
    """Arrays of ``(chunk int, part int, payload binary)`` of ``dtype`` summed by chunk as ``total``, over two levels, so
    that no task gathers more than ``fan_in`` or (parts / fan_in) payloads. ``decode``: from payload to bytes. The result
    goes to the driver: callers keep the number of chunks and their length fixed by parameters, whatever the input."""

    def adding(dtype: str, decode: Callable):
        def add(table: pa.Table) -> pa.Table:
            out = None
            for x in table.column("payload").to_pylist():
                a = np.frombuffer(decode(x), dtype=dtype)
                out = a.astype(total) if out is None else np.add(out, a, out=out)
            return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "payload": pa.array([out.tobytes()], pa.binary())})

        return add

    schema = "chunk int, part int, payload binary"
    one = df.withColumn("salt", F.floor(F.col("part") / fan_in)).groupBy("chunk", "salt").applyInArrow(adding(dtype, decode), schema)
    two = one.groupBy("chunk").applyInArrow(adding(total, bytes), schema)
    return {r.chunk: np.frombuffer(bytes(r.payload), dtype=total) for r in two.collect()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
