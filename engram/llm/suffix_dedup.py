"""Suffix-array dedup: bytes that a string of ``SPAN`` (100) bytes covers which also starts earlier in the corpus are removed.

"Earlier" is by document id, then by start. Every start of such a string is a suffix to be sorted to a depth of 100 bytes, which is all
that its repeats depend on. Suffixes don't travel one by one: those whose next 100 bytes hold the same sampled place
(``anchors``: the leftmost smallest hash of 40 bytes, so it depends on the 100 bytes alone) travel as one stretch of text.

1. ``repeated``: 40-byte strings at anchors that occur once can't be in a repeated string; their suffixes go. A batch's own
   repeats are known at once and don't meet in one place, so a frequent string arrives as one row for each batch.
2. ``stretches``: the text of the suffixes that are left. Of equal stretches in a batch of documents only the first travels.
3. ``sort_bucket``: sampled splitters range-partition the stretches by their leading tokens (16 bytes from the anchor on), then by document and place,
   so a frequent string is split over as many buckets as it fills. Each bucket is sorted by a multikey quicksort, 8 bytes a step: every
   part that is still undecided is divided by its next 8 bytes, parts of one are done. Stretches first, then the suffixes of those that differ.
4. ``across``: a leading string may go on in the next bucket only if it is a bucket's first or last; the suffixes below it that no other
   precedes in the bucket are compared across buckets.
5. ``removed``: each document's runs are merged, and its bytes hashed without them.

Comparisons are of bytes; hashes only choose anchors and rule out. Defined results: a null text counts as empty; shorter texts than SPAN lose nothing;
matches never cross documents; very long texts are read in steps; documents that share an id, or have none, are ordered by (id, nulls first, digest of the text), and
rows that repeat entirely one after the other; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _bytes_of, cut, parts, table, tidy, utf8

SPAN, CORE = 100, 40
#: Bytes of an anchor's string by which stretches are dealt out.
LEAD = 16
#: Suffixes' stretches in a bucket, about 130 bytes each.
BUCKET = 64_000
_STEP = 60_000
_ODD = [int(x) | 1 for x in np.random.default_rng(7).integers(1 << 62, 1 << 63, 64)]
_LOW = np.uint64(0xFFFF)
_RUNS = "key long, start int, stop int"


def _unaligned(data: np.ndarray, kind: str) -> np.ndarray:
    """The 8 bytes from each place on, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), kind, padded.tobytes(), strides=(1,))


def anchors(data: np.ndarray, at: np.ndarray, span: int = SPAN, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose next ``span`` bytes have the same anchor: first start, number of starts, anchor, hash of the anchor's bytes.

    ``at``: where each text begins in ``data``, and its end. Only starts with ``span`` bytes left in their text count.
    """
    n, width = len(data), span - core + 1
    fits = np.zeros(n + 1, np.int8)
    whole = np.diff(at) >= span
    np.add.at(fits, at[:-1][whole], 1)
    np.add.at(fits, at[1:][whole] - (span - 1), -1)
    fits = np.cumsum(fits[:-1], dtype=np.int8) > 0
    eight = _unaligned(data, "<u8")
    out = []
    for low in range(0, n, _STEP):
        size = min(n - low, _STEP)
        if not fits[low : low + size].any():
            continue
        places = min(size + width - 1, n - core - low + 1)
        if places < 1:
            break
        h = np.zeros(places, np.uint64)
        for k, t in enumerate([*range(0, core - 8, 8), core - 8]):
            h += eight[low + t : low + t + places] * np.uint64(_ODD[k])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        # The smallest of each window: its hash's upper bits, then its place, so that of equal ones the leftmost counts.
        least, done = np.full(size + width - 1, ~np.uint64(0)), 1
        least[:places] = (h & ~_LOW) | np.arange(places, dtype=np.uint64)
        while 2 * done <= width:
            least, done = np.minimum(least[:-done], least[done:]), 2 * done
        if done < width:
            least = np.minimum(least[: -(width - done)], least[width - done :])
        anchor, good = (least & _LOW).astype(np.int64), fits[low : low + size]
        edge = np.ones(size, bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
        first = np.flatnonzero(edge)
        stop, keep = np.append(first[1:], size), good[first]
        first, stop = first[keep], stop[keep]
        out.append((first + low, stop - first, anchor[first] + low, h[anchor[first]].astype(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def equal_runs(eight: np.ndarray, start: np.ndarray, size: np.ndarray | int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings of ``size`` bytes (8 at least, the same within a group) at ``start``, group by group. Returns the numbers
    of those that have an equal in their group, sorted, and for each the number of its set of equals."""
    index, size = np.arange(len(start)), np.broadcast_to(size, start.shape)
    if not len(index):
        return index, index
    order = np.argsort(group, kind="stable")
    index, group = index[order], group[order]
    most = int(size.max(initial=0))
    for depth in range(-8, most, 8):
        if depth < 0:
            new = group[1:] != group[:-1]
        else:
            token = eight[start[index] + np.minimum(depth, size[index] - 8)].astype(np.uint64)
            order = np.lexsort((token, group))
            index, group, token = index[order], group[order], token[order]
            new = (group[1:] != group[:-1]) | (token[1:] != token[:-1])
        begins = np.append(True, new)
        group = np.cumsum(begins)
        keep = ~(begins & np.append(new, True))  # parts of one are done
        index, group = index[keep], group[keep]
        if not len(index):
            break
    return index, group


def _later(index: np.ndarray, group: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each set of equals all but the one that starts first."""
    order = np.lexsort((place[index], key[index], group))
    group, index = group[order], index[order]
    return index[np.append(False, group[1:] == group[:-1])] if len(index) else index


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def repeated(docs: DataFrame, span: int, core: int) -> DataFrame:
    """(key, hash): the anchors' hashes of each document that occur more than once."""

    @tidy
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                data, at = _bytes_of(part.column("text"))
                _, _, anchor, h = anchors(data, at, span, core)
                if not len(h):
                    continue
                doc = np.searchsorted(at, anchor, "right") - 1
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new_hash = np.append(True, h[1:] != h[:-1])
                count = np.diff(np.append(np.flatnonzero(new_hash), len(h)))
                often = np.repeat(count > 1, count)
                each = new_hash | np.append(True, doc[1:] != doc[:-1])
                key = part.column("key").to_numpy()
                # kind 0: once in this batch; 1: known to be repeated; 2: says so to the other batches
                one, many, told = each & ~often, each & often, new_hash & often
                yield _batch(
                    hash=np.concatenate([h[one], h[many], h[told]]),
                    key=np.concatenate([key[doc[one]], key[doc[many]], np.zeros(int(told.sum()), np.int64)]),
                    kind=np.repeat(np.array([0, 1, 2], np.int8), [int(one.sum()), int(many.sum()), int(told.sum())]),
                )

    @tidy
    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, told = [], [], []
        for b in batches:
            h, key, kind = (b.column(i).to_numpy() for i in range(3))
            if (kind == 1).any():
                yield _batch(key=key[kind == 1], hash=h[kind == 1])
            hashes.append(h[kind == 0])
            keys.append(key[kind == 0])
            told.append(h[kind == 2])
        if not hashes:
            return
        h, key, told = np.concatenate(hashes), np.concatenate(keys), np.unique(np.concatenate(told))
        order = np.argsort(h, kind="stable")
        h, key = h[order], key[order]
        same = h[1:] == h[:-1]
        often = np.append(False, same) | np.append(same, False) if len(h) else np.zeros(0, bool)
        if len(told):
            near = np.minimum(np.searchsorted(told, h), len(told) - 1)
            often |= told[near] == h
        for i in range(0, len(h), 1 << 20):
            keep = often[i : i + (1 << 20)]
            yield _batch(key=key[i : i + (1 << 20)][keep], hash=h[i : i + (1 << 20)][keep])

    rows = docs.mapInArrow(found, "hash long, key long, kind byte")
    # What is known already goes by document, the rest by hash: at most one row for each hash and batch.
    return rows.repartition(F.when(F.col("kind") == 1, F.col("key")).otherwise(F.col("hash"))).mapInArrow(decided, "key long, hash long")


def stretches(docs: DataFrame, wanted: DataFrame, span: int, core: int) -> DataFrame:
    """(key, spot, bytes) of the suffixes at wanted anchors, spot being start x 2^31 + anchor's distance; bytes null: spot is start x 2^31 +
    length of a run of bytes that starts earlier in the same batch of documents, so that it need not travel. ``wanted``: (key, hash)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                data, at = _bytes_of(part.column("text"))
                first, n, anchor, h = anchors(data, at, span, core)
                doc = np.searchsorted(at, first, "right") - 1
                lists = part.column("hashes")
                hashes, owner = lists.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                # Pairs of document and hash that are wanted.
                pairs = np.concatenate([np.stack([owner, hashes], 1), np.stack([doc, h], 1)])
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                edge = np.append(True, (pairs[order][1:] != pairs[order][:-1]).any(1)) if len(pairs) else np.zeros(0, bool)
                number = np.empty(len(pairs), np.int64)
                number[order] = np.cumsum(edge)
                ask = number[len(hashes) :]
                pick = np.flatnonzero(np.isin(ask, number[: len(hashes)]))
                first, n, anchor, doc = first[pick], n[pick], anchor[pick], doc[pick]
                _, inverse, count = np.unique(h[pick], return_inverse=True, return_counts=True)
                twice = np.flatnonzero(count[inverse] > 1) if len(pick) else np.zeros(0, np.int64)
                twice = twice[np.lexsort((first[twice], part.column("key").to_numpy()[doc[twice]]))]
                raw, again, seen = data.tobytes(), np.zeros(len(first), bool), set()
                for i in twice.tolist():  # strings that start earlier in these documents
                    s = int(first[i])
                    what = (int(anchor[i]) - s, raw[s : s + int(n[i]) + span - 1])
                    again[i] = what in seen
                    seen.add(what)
                key, local = part.column("key").to_numpy()[doc], first - at[doc]
                text = [None if x else raw[s : s + m + span - 1] for s, m, x in zip(first.tolist(), n.tolist(), again.tolist(), strict=True)]
                spot = (local << 31) + np.where(again, n + span - 1, anchor - first)
                yield _batch(key=key, spot=spot, bytes=pa.array(text, pa.binary()))

    asked = wanted.groupBy("key").agg(F.collect_list("hash").alias("hashes"))
    return docs.join(asked, "key").select("key", "text", "hashes").mapInArrow(run, "key long, spot long, bytes binary")


def sort_bucket(rows: DataFrame, span: int, core: int) -> DataFrame:
    """Of each bucket (key, start, stop): runs of bytes that repeat what starts earlier; and, with ``suffix``, (key, start) of suffixes that come first in
    their bucket but may have an equal in another."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            known = b.column(2).is_null()
            if known.true_count:
                own = b.filter(known)
                spot = own.column(1).to_numpy()
                yield _runs(own.column(0).to_numpy(), spot >> 31, (spot >> 31) + (spot & 0x7FFFFFFF))
            if known.false_count:
                got.append(b.filter(b.column(2).is_valid()))
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks().to_batches()[0]
        got.clear()
        key, spot = t.column(0).to_numpy(), t.column(1).to_numpy()
        start, anchor = spot >> 31, spot & 0x7FFFFFFF
        data, at = _bytes_of(t.column(2))
        place, size = at[:-1], np.diff(at)
        n = size - (span - 1)
        eight = _unaligned(data, ">u8")
        # Stretches that are equal in all: the one that starts first stands for them.
        shape = size * (1 << 20) + anchor
        gone = _later(*equal_runs(eight, place, size, shape), key, start)
        yield _runs(key[gone], start[gone], start[gone] + size[gone])
        keep = np.ones(len(key), bool)
        keep[gone] = False
        rest = np.flatnonzero(keep)
        del keep, shape
        width = min(LEAD, core)
        leads, outer = data[(place[rest] + anchor[rest])[:, None] + np.arange(width)], np.zeros(len(rest), bool)
        for edge in (np.min, np.max):  # the first and the last leading string of the bucket
            left = np.arange(len(rest))
            for c in range(width):
                left = left[leads[left, c] == edge(leads[left, c])]
            outer[left] = True
        del leads
        # Those whose anchor's string is that of another stretch, or may be in another bucket.
        index, group = equal_runs(eight, place[rest] + anchor[rest], core, np.zeros(len(rest), np.int64))
        code = np.where(outer, len(rest) + 1 + np.arange(len(rest)), 0)
        code[index] = group
        keep = np.flatnonzero(code)
        rest, code, outer = rest[keep], code[keep], outer[keep]
        order = np.argsort(code, kind="stable")
        rest, code, outer = rest[order], code[order], outer[order]
        # The suffixes of the others, those of some leading strings at a time.
        total, low = np.cumsum(n[rest]), 0
        while low < len(rest):
            high = int(np.searchsorted(total, (total[low - 1] if low else 0) + 1_000_000, "right"))
            high = int(np.searchsorted(code, code[max(high - 1, low)], "right"))
            some, some_code, some_outer, low = rest[low:high], code[low:high], outer[low:high], high
            row = np.repeat(np.arange(len(some)), n[some])
            step = np.arange(len(row)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            row, lead_no, apart = some[row], some_code[row], some_outer[row]
            at_row, ahead = place[row] + step, anchor[row] - step
            index, group = equal_runs(eight, at_row, span, lead_no * (1 << 20) + ahead)
            late = _later(index, group, key[row], start[row] + step)
            first = np.ones(len(row), bool)
            first[late] = False
            late.sort()
            # Neighbouring starts of one stretch are one run.
            if len(late):
                new = np.append(True, (row[late][1:] != row[late][:-1]) | (np.diff(late) != 1))
                head, tail = late[new], late[np.append(np.flatnonzero(new)[1:] - 1, len(late) - 1)]
                yield _runs(key[row[head]], start[row[head]] + step[head], start[row[tail]] + step[tail] + span)
            told = np.flatnonzero(first & apart)
            for i in range(0, len(told), 20_000):
                x = told[i : i + 20_000]
                chars = data[at_row[x][:, None] + np.arange(span)]
                ends = np.arange(0, (len(x) + 1) * span, span, dtype=np.int32)
                suffix = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(chars.tobytes())])
                yield _batch(key=key[row[x]], start=pa.array(start[row[x]] + step[x], pa.int32()), stop=pa.nulls(len(x), pa.int32()), suffix=suffix)

    def _runs(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        return _batch(key=key, start=pa.array(start, pa.int32()), stop=pa.array(stop, pa.int32()), suffix=pa.nulls(len(key), pa.binary()))

    return rows.mapInArrow(run, _RUNS + ", suffix binary")


def across(firsts: DataFrame, span: int) -> DataFrame:
    """Runs of suffixes that precede all equals in their bucket, but not those in all buckets. At most one of each bucket is gathered."""
    spot = F.struct("key", "start")
    sets = firsts.groupBy("suffix").agg(F.min(spot).alias("first"), F.collect_list(spot).alias("all")).filter(F.size("all") > 1)
    later = sets.select("first", F.explode("all").alias("one")).filter(F.col("one") > F.col("first"))
    return later.select(F.col("one.key").alias("key"), F.col("one.start").alias("start"), (F.col("one.start") + span).alias("stop"))


def removable(docs: DataFrame, span: int = SPAN, core: int = CORE, bucket: int = BUCKET) -> DataFrame:
    """(key, start, stop): runs of bytes, overlapping or not, of documents (key, text) that repeat what starts earlier."""
    wanted = cut(repeated(docs, span, core), spent=True)
    rows = stretches(docs, wanted, span, core)
    lead = F.substring("bytes", F.col("spot").bitwiseAND(0x7FFFFFFF).cast("int") + 1, F.lit(min(LEAD, core)))  # not a column: it is in the bytes
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-wanted.count() // bucket))
    sorted_ = cut(sort_bucket(rows.repartitionByRange(buckets, lead, "key", "spot"), span, core), spent=True)
    runs = sorted_.filter("suffix is null").select("key", "start", "stop")
    return runs.unionByName(across(sorted_.filter("suffix is not null"), span))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs, ascending."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text): key is the id, or, where ids are null or repeated, a number in the order of (id, digest of the text)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and not rows.groupBy("id").count().filter("count > 1 or id is null").take(1):
        return rows.select(F.col("id").cast("long").alias("key"), "id", "text")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = rows.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.monotonically_increasing_id().alias("copy"))
    placed = told.repartitionByRange(buckets, "id", "digest", "copy").sortWithinPartitions("id", "digest", "copy")
    return cut(placed.select(F.monotonically_increasing_id().alias("key"), "id", "text"), spent=True)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, span: int = SPAN, core: int = CORE, bucket: int = BUCKET) -> DataFrame:
    """(id, n_bytes, spans, kept) of every document: the maximal removed runs of its UTF-8 bytes, and the bytes that stay."""
    rows = keyed(docs, id_col, text_col)
    runs = removable(rows.select("key", "text"), span, core, bucket)
    by_doc = runs.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                spans, kept, sizes = [], [], []
                for text, found in zip(utf8(part, "text"), part.column("runs").to_pylist(), strict=True):
                    at, rest, mine = 0, [], merged([(x["start"], x["stop"]) for x in found or []])
                    for a, b in mine:
                        rest.append(text[at:a])
                        at = b
                    spans.append([{"start": a, "stop": b} for a, b in mine])
                    kept.append(b"".join([*rest, text[at:]]))
                    sizes.append(len(text))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    met = rows.join(by_doc, "key", "left").select("id", "text", "runs")
    return met.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every document with what it loses."""
    found = removed(table(spark, sf_dir, "documents"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, unnest(range(0, greatest(strlen(h) // 2 - 99, 0))) as p from d),
s as (select w.doc_id, p, md5(substr(h, 2 * p + 1, 200)) as m from w join d using (doc_id)),
f as (select m, min((doc_id, p)) as first from s group by m having count(*) > 1),
r as (select doc_id, p, case when p > coalesce(lag(p) over (partition by doc_id order by p), -1000) + 100 then 1 else 0 end as new from s join f using (m) where (s.doc_id, s.p) > f.first),
i as (select doc_id, p, sum(new) over (partition by doc_id order by p) as island from r),
x as (select doc_id, island, min(p) as a, max(p) + 100 as b from i group by all),
k as (select doc_id, island, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from x),
g as (select k.doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head from k join d using (doc_id) group by k.doc_id)
select d.doc_id, strlen(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(from_hex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join g using (doc_id)
"""
