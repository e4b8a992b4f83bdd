"""Substring deduplication: words covered by a window of ``WIDTH`` words that also starts elsewhere are removed.

1. Every window has an anchor, its smallest five-word hash, so equal windows have equal anchors.
   Consecutive windows of one anchor form a stretch (half a window's worth of windows on average). Anchors are
   counted with partial aggregation; windows of an anchor that occurs once can't be repeated.
2. Stretches of the same words are counted, not copied: all their windows are repeated. An anchor's different
   stretches, one of each, go to one shard.
3. Each shard is indexed by a compressed FM-index, and its stretches stream through backward search, which
   gives the range of windows with matching length ``WIDTH`` elsewhere.
4. An anchor with more than ``hot`` different stretches is split: its stretches are cut again, by the smallest hash of a
   second order, and steps 2 and 3 are repeated for the parts. What is still over ``hot`` after ``LEVELS`` orders (windows that
   differ in few words only) has its windows counted by hash, with partial aggregation: the exact way for the rest, at any size.
5. A document's ranges meet its text, and the words in them go.

Memory: a shard part holds about ``SHARD_WORDS`` words, and at most ``hot`` stretches of one anchor; nothing is gathered by
key but a document's own ranges.

Defined results: null and empty texts have no words (the digest is that of the empty text); documents
shorter than a window lose nothing; repeated rows are copies of each other; rows that share an id are told
apart by their texts; an empty table gives an empty result; very long texts are hashed step by step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, parts, table, tidy, utf8, word_hashes
from .fm_index import FMIndex, repeated_range

WIDTH, GRAM, HOT, SHARD_WORDS, LEVELS, SALTS = 35, 5, 2_000, 400_000, 3, 8
_P, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hash of any stretch of ``a`` from one running sum."""

    def __init__(self, a: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(a * _powers(_B, len(a)), dtype=np.uint64)))
        self.back = _powers(_B_INVERSE, len(a) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _P)


def stretches(a: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM, order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of the stretches of documents ``a[bounds[i]:bounds[i + 1]]``. ``order``: which order
    of the hashes decides what is smallest. A gram is as long as a window at most."""
    if width < 1 or gram < 1:
        raise ValueError("width and gram must be at least 1")
    gram = min(gram, width)
    if len(a) < width:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
    g = np.zeros(len(a) - gram + 1, np.uint64)
    for i in range(gram):
        g = g * _P + a[i : i + len(g)]
    g = mix64(g + np.uint64(order * int(_B) % (1 << 64)))
    span = width - gram + 1
    at, have = np.arange(len(g)), 1
    while have < span:
        shift = min(have, span - have)
        left, right = at[:-shift], at[shift:]
        at = np.where(g[left] <= g[right], left, right)
        have += shift
    size = np.diff(bounds)
    last = np.repeat(bounds[1:], size)[: len(at)] - width
    valid = np.flatnonzero(np.arange(len(at)) <= last)
    anchor = at[valid]
    if not len(valid):
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
    # A row's windows begin anew: rows that follow each other never share a stretch.
    row = np.searchsorted(bounds, valid, side="right")
    edge = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    return g[anchor[edge]], valid[edge], np.diff(np.append(edge, len(valid)))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def anchor_counts(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, "text", 2_000_000):
                anchors, n = np.unique(stretches(*word_hashes(b.column("text")), width)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(anchors), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return rows.select("text").mapInArrow(tidy(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def anchored(rows: DataFrame, width: int) -> DataFrame:
    """Every stretch: anchor, content hash, document, first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, "text", 2_000_000):
                a, bounds = word_hashes(b.column("text"))
                anchor, first, n = stretches(a, bounds, width)
                content = Hashes(a).of(first, first + n + width - 1)
                doc = np.searchsorted(bounds, first, side="right") - 1
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(content), b.column("doc_id").take(at), b.column("th").take(at), pa.array(first - bounds[doc]), pa.array(n)], names=["anchor", "content", "doc_id", "th", "first", "windows"])

    return rows.mapInArrow(tidy(run), "anchor long, content long, doc_id long, th int, first long, windows long")


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _with_text(picked: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents of ``picked`` stretches with their text, once for each (id, text), and the stretches as a list."""
    lists = picked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "first", "windows", "n", "hot")).alias("picked"))
    return rows.join(lists, _same(rows, lists)).select(rows["doc_id"], rows["th"], "text", "picked")


_PAYLOAD = "doc_id long, th int, anchor long, first long, n long, words binary"


def _payload_batch(doc_id: pa.Array, th: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    at = pa.array(cols[0], pa.int64())
    kinds = [pa.int64()] * 3 + [pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([doc_id.take(at), th.take(at), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], names=["doc_id", "th", "anchor", "first", "n", "words", "hot"])


def _payload(docs: DataFrame, width: int) -> DataFrame:
    """The words (hashes) of each picked stretch, and whether its anchor is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, "text", 2_000_000):
                a, bounds = word_hashes(b.column("text"))
                rows = []
                for i, picked in enumerate(b.column("picked").to_pylist()):
                    own = a[bounds[i] : bounds[i + 1]]
                    rows += [(i, x["anchor"], x["first"], x["n"], own[x["first"] : x["first"] + x["windows"] + width - 1].tobytes(), x["hot"]) for x in picked]
                yield _payload_batch(b.column("doc_id"), b.column("th"), rows)

    return docs.mapInArrow(tidy(run), _PAYLOAD + ", hot boolean")


def _cut_again(payload: DataFrame, width: int, order: int) -> DataFrame:
    """The stretches of ``payload`` cut by another order of the hashes, with their content hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                words = part.column("words").to_pylist()
                bounds = np.concatenate(([0], np.cumsum([len(w) // 8 for w in words]))).astype(np.int64)
                a = np.frombuffer(b"".join(words), np.uint64)
                anchor, first, n = stretches(a, bounds, width, order=order)
                content = Hashes(a).of(first, first + n + width - 1)
                row = np.searchsorted(bounds, first, side="right") - 1
                at = pa.array(row)
                old = np.asarray(part.column("anchor"), np.int64).view(np.uint64)[row]
                begin = np.asarray(part.column("first"), np.int64)[row] + first - bounds[row]
                cuts = pa.array([a[s : s + k + width - 1].tobytes() for s, k in zip(first.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("th").take(at), _signed(mix64(old + anchor * _P)), pa.array(begin), part.column("n").take(at), cuts, _signed(content)], names=["doc_id", "th", "anchor", "first", "n", "words", "content"])

    return payload.mapInArrow(tidy(run), _PAYLOAD + ", content long")


def _search(width: int, shard_words: int):
    """Rows sorted by anchor: index whole anchors in parts of about ``shard_words`` words and search them."""

    def ranges(held: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(x[4]) // 8 for x in held])
        start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        flat = np.frombuffer(b"".join(x[4] + b"\0" * 8 for x in held), np.uint64)
        _, seq = np.unique(flat, return_inverse=True)
        seq = seq.astype(np.int64) + 1
        seq[start + size] = 0  # the end of a stretch, in no pattern
        asked = np.flatnonzero(np.array([x[3] for x in held]) == 1)
        first, last = repeated_range(FMIndex(seq, width), seq, start[asked], size[asked] - width + 1, width)
        hit = np.flatnonzero(first >= 0)
        rows = [held[asked[i]] for i in hit]
        begin = np.array([x[2] for x in rows], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array(begin + first[hit], pa.int64()), pa.array(begin + last[hit] + width, pa.int64())],
            names=["doc_id", "th", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, anchor = [], 0, None
        for b in batches:
            for d, t, x, p, n, w in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "anchor", "first", "n", "words")), strict=True):
                if x != anchor and words > shard_words:
                    yield ranges(held)
                    held, words = [], 0
                if held and held[-1][:3] == (d, t, p) and x == anchor:
                    continue  # a repeated row of a document
                anchor = x
                held.append((d, t, p, n, w))
                words += len(w) // 8
        if held:
            yield ranges(held)

    return run


def _windows(payload: DataFrame, width: int) -> DataFrame:
    """Single windows of stretches, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                words = part.column("words").to_pylist()
                size = np.array([len(w) // 8 for w in words], np.int64)
                base = np.concatenate(([0], np.cumsum(size)))[:-1]
                n = size - width + 1
                row = np.repeat(np.arange(len(words)), n)
                offset = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
                s = base[row] + offset
                h = Hashes(np.frombuffer(b"".join(words), np.uint64)).of(s, s + width)
                at = pa.array(row)
                begin = np.asarray(part.column("first"), np.int64)
                yield pa.RecordBatch.from_arrays([_signed(h), part.column("n").take(at), part.column("doc_id").take(at), part.column("th").take(at), pa.array(begin[row] + offset)], names=["h", "n", "doc_id", "th", "a"])

    return payload.mapInArrow(tidy(run), "h long, n long, doc_id long, th int, a long")


def _salted(df: DataFrame, side: str) -> DataFrame:
    """A hot content's rows over ``SALTS`` parts, and the other side of their join in each part."""
    salt = F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int") if side == "rows" else F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return df.withColumn("salt", salt)


def _sharded(payload: DataFrame, width: int, shard_words: int) -> DataFrame:
    return payload.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "th", "first").mapInArrow(tidy(_search(width, shard_words)), "doc_id long, th int, a long, b long")


def _split(payload: DataFrame, width: int, hot: int, shard_words: int, order: int = 1) -> DataFrame:
    """(doc_id, th, a, b): repeated ranges among the stretches of anchors that have too many of them for a shard."""
    if order < LEVELS:
        finer = cut(_cut_again(payload, width, order))
        one = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "first")).alias("one")
        contents = cut(finer.groupBy("anchor", "content").agg(F.sum("n").alias("t"), one))
        copied = _salted(finer, "rows").join(_salted(contents.filter("t > 1").select("anchor", "content"), "keys"), ["anchor", "content", "salt"], "left_semi")
        out = copied.select("doc_id", "th", F.col("first").alias("a"), (F.col("first") + F.length("words") / 8).cast("long").alias("b"))
        kinds = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        picked = contents.join(kinds, "anchor").select("anchor", "content", "t", "one.doc_id", "one.th", "one.first", (F.col("kinds") > hot).alias("hot"))
        f, k = finer.drop("n").alias("f"), picked.alias("k")
        met = (F.col("f.anchor") == F.col("k.anchor")) & (F.col("f.content") == F.col("k.content")) & F.col("f.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("f.th") == F.col("k.th")) & (F.col("f.first") == F.col("k.first"))
        named = cut(f.join(k, met).select("f.doc_id", "f.th", "f.anchor", "f.first", F.col("k.t").alias("n"), "f.words", "k.hot"))
        out = out.unionByName(_sharded(named.filter("not hot").drop("hot"), width, shard_words))
        payload = named.filter("hot").drop("hot")
        return out.unionByName(_split(payload, width, hot, shard_words, order + 1)) if payload.take(1) else out
    windows = cut(_windows(payload, width).dropDuplicates(["h", "doc_id", "th", "a"]))
    twice = windows.groupBy("h").agg(F.sum("n").alias("t")).filter("t > 1").select("h")
    found = _salted(windows, "rows").join(_salted(twice, "keys"), ["h", "salt"], "left_semi")
    return found.select("doc_id", "th", "a", (F.col("a") + width).alias("b"))


def repeated_ranges(docs: DataFrame, *, width: int = WIDTH, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, th, a, b): word ranges covered by repeated windows; ``docs`` has doc_id, text and th (a hash of the text)."""
    stretch = anchored(docs, width)
    # Written first, so that both sides of the join come from plain exchanges, whose hot partitions can be split.
    repeated = cut(anchor_counts(docs, width))
    found = cut(stretch.join(repeated, "anchor", "left_semi"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "first", "windows")).alias("one")
    contents = cut(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), first))
    copied = _salted(found, "rows").join(_salted(contents.filter("n > 1").select("anchor", "content"), "keys"), ["anchor", "content", "salt"], "left_semi")
    copied = copied.select("doc_id", "th", F.col("first").alias("a"), (F.col("first") + F.col("windows") + (width - 1)).alias("b"))
    kinds = cut(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    picked = contents.join(kinds, "anchor").select("anchor", "n", "one.doc_id", "one.th", "one.first", "one.windows", (F.col("kinds") > hot).alias("hot"))
    # Written once for both ways, so that the texts move once.
    payload = cut(_payload(_with_text(picked, docs), width))
    out = copied.unionByName(_sharded(payload.filter("not hot").drop("hot"), width, shard_words))
    if kinds.filter(F.col("kinds") > hot).take(1):
        again = payload.filter("hot").drop("hot").dropDuplicates(["doc_id", "th", "anchor", "first"])
        out = out.unionByName(_split(again, width, hot, shard_words))
    return out


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = HOT, shard_words: int = SHARD_WORDS, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and the kept words joined by blanks as ``kept_text`` if asked for."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.hash("text"))
    ranges = repeated_ranges(rows, width=width, hot=hot, shard_words=shard_words)
    lists = ranges.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    met = rows.join(lists, _same(rows, lists), "left").select(rows["doc_id"], "text", "ranges")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ranges in zip(utf8(b, "text"), b.column("ranges").to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if ranges:
                    gone = np.zeros(n + 1, np.int64)
                    for x in ranges:
                        gone[x["a"]] += 1
                        gone[x["b"]] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts else [])))
            cols = list(zip(*out, strict=True)) or [[] for _ in names[1:]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=names)

    return met.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document without the passages of 35 words that are repeated anywhere."""
    return remove(table(spark, sf_dir, "documents"))


ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) as c from g) where c > 1),
cov as (select distinct doc_id, unnest(range(i, i + 35)) as p from r),
x as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
k as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as kept from x anti join cov using (doc_id, p) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)
"""
