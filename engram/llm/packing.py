"""Best-fit packing with certified bounds and repacking.

Documents become token pieces of at most ``capacity``. Each partition packs its pieces best-fit decreasing
and compares its bin count with a lower bound from dual-feasible functions. A partition that meets its
bound is certified and done. In the others, bins with room left give their pieces to an exchange: they are
dealt out anew over fewer partitions and packed again, and the outcome stands only where it needs fewer bins. Exchanges go
on until all partitions are certified, one is left, or an exchange saves no bin.

A partition holds at most about ``per_partition`` pieces (tens of bytes each), so memory is bounded; the
exchange shrinks from round to round.

Defined results: null and empty texts are one piece (the end id alone); a text of more than ``capacity`` ids
is cut from its end, so that its first piece may be shorter; repeated rows are packed each on its own and dealt out like others;
pieces of equal length are packed in the order they come; an empty table gives an empty result; very long texts are encoded whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_format import encoder
from .common import cut, strings, table, tidy

CAPACITY, END_ID = 1024, 2
_SPECIAL = "<|endoftext|>"


def default_vocab() -> tuple[str, str]:
    """The vocabulary as a tokenizers file and as merge ranks; both give the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, vocab: tuple[str, str], end_id: int = END_ID) -> np.ndarray:
    """The text's ids and the end id. The rank encoder gives the tokenizers file's ids for ordinary text, several
    times faster; texts that spell its special token are left to the file itself."""
    if _SPECIAL in text:
        ids = _tokenizer(vocab[0]).encode(text, add_special_tokens=False).ids
    else:
        ids = encoder(vocab[1]).encode_ordinary(text)
    return np.array([*ids, end_id], "<u4")


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, *, vocab: tuple[str, str] | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document."""
    names = vocab or default_vocab()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(strings(b, "text")):
                ids = ids_of(text, names)
                for k, (s, n) in enumerate(pieces_of(len(ids), capacity)):
                    rows.append((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.selectExpr(f"cast({id_col} as bigint) doc_id", f"{text_col} as text")
    return rows.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions on the size histogram."""
    if not len(lengths):
        return 0
    h = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((h * size).sum()) // capacity)
    count, total = np.concatenate(([0], np.cumsum(h))), np.concatenate(([0], np.cumsum(h * size)))
    half = capacity // 2
    big, big_sum = int(count[-1] - count[half + 1]), total
    for k in range(half + 1):  # sizes over capacity - k count whole, sizes below k not at all
        whole = int(count[-1] - count[capacity - k + 1])
        middle = big - whole
        middle_sum = int(big_sum[capacity - k + 1] - big_sum[half + 1])
        small_sum = int(total[half + 1] - total[min(k, half + 1)])
        best = max(best, big + max(0, -(-(small_sum - (middle * capacity - middle_sum)) // capacity)))
    for k in range(1, 64):  # rounded to multiples of 1/k unless (k + 1) * size / capacity is whole
        up = (k + 1) * size
        value = np.where(up % capacity == 0, size * k, up // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((h * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Open bins are kept by room left; a bitmap of the
    rooms that occur gives the tightest fit."""
    n = len(lengths)
    bins, offset, used = np.empty(n, np.int64), np.empty(n, np.int64), 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            b, room, used = used, capacity, used + 1
        bins[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins, offset, used


_COLS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _pack(round_no: int, capacity: int):
    """Packs a partition. Rows may come with an earlier packing, which stays if the new one isn't smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        lengths = t.column("length").to_numpy()
        bins, offset, used = best_fit_decreasing(lengths, capacity)
        sequence = (round_no << 56) + (TaskContext.get().partitionId() << 30) + bins
        if round_no:
            old = t.column("sequence_id").to_numpy()
            if len(np.unique(old)) <= used:
                sequence, offset = old, t.column("offset").to_numpy()
                used = len(np.unique(old))
        certified = used <= lower_bound(lengths, capacity)
        _, where = np.unique(sequence, return_inverse=True)
        room = capacity - np.bincount(where, weights=lengths).astype(np.int64)
        loose = np.zeros(len(lengths), bool) if certified else room[where] > 0
        new = {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()), "open": pa.array(loose)}
        out = pa.table({c: t.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | new)
        yield from out.to_batches(max_chunksize=50_000)

    return run


def pack(rows: DataFrame, *, capacity: int = CAPACITY, per_partition: int = 50_000, rounds: int = 100) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset. ``rounds``: exchanges after the first packing at most; they end
    before, when all partitions are certified, one is left, or an exchange saves no bin."""
    rows = cut(rows)
    parts = max(1, math.ceil(rows.count() / per_partition))
    # By the place in the written table too, so that rows that repeat (or null ids) are dealt out like any others.
    dealt = rows.withColumn("_place", F.monotonically_increasing_id())
    now = cut(dealt.repartition(parts, F.xxhash64("doc_id", "piece", "ids_crc32", "_place")).drop("_place").mapInArrow(_pack(0, capacity), _COLS))
    done, loose = [now.filter("not open")], now.filter("open")
    bins = lambda df: df.select("sequence_id").distinct().count()
    for r in range(1, min(rounds, 100) + 1):
        n = loose.count()
        if not n or parts == 1:
            break
        before, parts = bins(loose), min(parts - 1, max(1, math.ceil(n / per_partition)))
        # Whole bins move, so an earlier packing can stand where the new one is no better.
        now = cut(loose.repartition(parts, F.xxhash64("sequence_id", F.lit(r))).mapInArrow(_pack(r, capacity), _COLS))
        done.append(now.filter("not open"))
        loose = now.filter("open")
        if bins(now) >= before:
            break
    out = loose
    for d in done:
        out = out.unionByName(d)
    return out.drop("open")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents packed into sequences of 1024 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents")))
