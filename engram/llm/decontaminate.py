"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every word sequence inside any item. Document words stream through it; the longest
matching length at each word says whether an item's window (13 words, or the whole of a shorter item) ends there,
and the state's items say whose. Runs of words whose neighbours never stand together in an item are skipped
before the automaton, since no window can lie across them.

The items are read to the driver in shards of at most ``shard_words`` words, one broadcast automaton each, so what is broadcast
is bounded whatever the size of the benchmark. With one shard the rows pass once and move nowhere. With more, each shard is a job
of its own that writes the rows it hits, so a worker holds one automaton at a time, and the hits are merged by row.

Defined results: null or empty texts have no words and are clean; items without words are skipped; a null
item_id counts as the empty string; items that tie (equal words) are all named; repeated rows are judged each on its own; an empty
benchmark leaves all clean; an empty table gives an empty result; very long texts are scanned in one pass; columns that are named like
a result are replaced by it.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, runs, shielded, table, tidy, utf8

WINDOW, SHARD_WORDS = 13, 500_000
#: A-Z is lowered; bytes of the class [0-9a-z] and all non-ASCII bytes stay; the rest become blanks.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with each window's items on its states. Once built, all steps are in
    one table (state and word to state), links and lengths in arrays: about a tenth of a kilobyte for each word of the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        ids = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, seq in ids:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.width = max(1, len(self.vocab))
        self.edges = {state * self.width + c: to for state, steps in enumerate(self.next) for c, to in steps.items()}
        del self.next
        self.link, self.len = array("q", self.link), array("q", self.len)
        self.long: dict[int, tuple[str, ...]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, seq in ids:
            at = 0
            for i, c in enumerate(seq):
                at = self.edges[at * self.width + c]
                if i + 1 >= window:
                    state = self.of_length(at)
                    if name not in (had := self.long.get(state, ())):
                        self.long[state] = (*had, name)
            if len(seq) < window:
                self.short.setdefault(at, []).append((len(seq), name))
        self.shorter = self._nearest_short()
        self.least = min((min(window, len(s)) for _, s in ids), default=0)
        self.pairs = np.zeros(1 << 20, bool)
        for _, seq in ids:
            a = np.array(seq, np.int64)
            self.pairs[self.pair(a[:-1], a[1:])] = True

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77) & ((1 << 20) - 1)

    def _new(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.len[last] + 1, {}, 0), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def of_length(self, state: int) -> int:
        """The state of the last ``window`` words of what ``state`` stands for."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _nearest_short(self) -> array:
        found = array("q", [-1]) * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.link[v]
            found[v] = up if up in self.short else found[up]
        return found

    def scan(self, seq: list[int]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(start, end, items) of each window's occurrence, from the matching lengths along ``seq``."""
        edges, width, link, lens, w = self.edges, self.width, self.link, self.len, self.window
        at = length = 0
        for i, c in enumerate(seq):
            while at and at * width + c not in edges:
                at = link[at]
                length = lens[at]
            to = edges.get(at * width + c)
            if to is None:
                at = length = 0
                continue
            at, length = to, length + 1
            if length >= w:
                yield i + 1 - w, i + 1, self.long[self.of_length(at)]
            v = at if at in self.short else self.shorter[at]
            while v != -1:
                for k, name in self.short[v]:
                    if k <= length:
                        yield i + 1 - k, i + 1, (name,)
                v = self.shorter[v]

    def hits(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document its hit word ranges (merged, ascending) and the items found."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
        if not self.least:
            return out
        get, starts = self.vocab.get, np.cumsum([0] + [len(d) + 1 for d in docs])
        ids = np.full(starts[-1] + 1, -1, np.int64)
        for s, d in zip(starts[:-1].tolist(), docs, strict=True):
            ids[s : s + len(d)] = np.fromiter((get(w, -1) for w in d), np.int64, len(d))
        known = ids >= 0
        if self.least == 1:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(np.int8), [0]))))
            begin, end = edges[::2], edges[1::2]
        else:
            ok = known[:-1] & known[1:] & self.pairs[self.pair(ids[:-1], ids[1:])]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.astype(np.int8), [0]))))
            begin, end = edges[::2], edges[1::2] + 1
        far = end - begin >= self.least
        begin, end = begin[far], end[far]
        where = np.searchsorted(starts, begin, side="right") - 1
        for b, e, doc in zip(begin.tolist(), end.tolist(), where.tolist(), strict=True):
            ranges, names = out[doc]
            base = b - int(starts[doc])
            found = [(base + x, base + y) for x, y, z in self.scan(ids[b:e].tolist()) if names.update(z) is None]
            for x, y in sorted(found):
                if ranges and x <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(y, ranges[-1][1]))
                else:
                    ranges.append((x, y))
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def shards(benchmark: DataFrame, id_col: str, text_col: str, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in lists of about ``shard_words`` words at most, one partition of the table at a time on the driver; one
    empty list if there are none."""
    held, n = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        words = words_of(r.t.encode())
        if held and n + len(words) > shard_words:
            yield held
            held, n = [], 0
        held.append((r.i, words))
        n += len(words)
    yield held


RESULTS = {"_n_words": "long", "_n_hit": "long", "_longest": "long", "_spans": "binary", "_items": "array<string>"}


def _told(n_words: list[int], ranges: list[list[tuple[int, int]]], names: list[list[str]]) -> dict[str, pa.Array]:
    return {
        "_n_words": pa.array(n_words, pa.int64()),
        "_n_hit": pa.array([sum(y - x for x, y in r) for r in ranges], pa.int64()),
        "_longest": pa.array([max((y - x for x, y in r), default=0) for r in ranges], pa.int64()),
        "_spans": pa.array([np.array(r, "<i8").tobytes() if r else None for r in ranges], pa.binary()),
        "_items": pa.array(names, pa.list_(pa.string())),
    }


def _split(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for whole in batches:
        texts = utf8(whole, text_col)
        for a, b in runs(map(len, texts), 2_000_000):
            yield whole.slice(a, b - a), [words_of(t) for t in texts[a:b]]


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_hit``, ``_longest`` (words of the longest hit span), ``_spans`` (binary: pairs of
    int64 word positions, merged) and ``_items`` (sorted)."""
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c not in RESULTS))
    docs, new, _ = shielded(docs)
    text, names, old = new[text_col], list(new.values()), list(new)
    every = shards(benchmark, item_id, item_text, shard_words)
    first, second = next(every), next(every, None)
    schema = docs.withColumns({c: F.lit(None).cast(t) for c, t in RESULTS.items()}).schema

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(n).alias(c) for n, c in zip(names, old, strict=True)), *RESULTS)

    if second is None:
        shared = spark.sparkContext.broadcast(SuffixAutomaton(first, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, words in _split(batches, text):
                found = shared.value.hits(words)
                told = _told([len(w) for w in words], [r for r, _ in found], [sorted(n) for _, n in found])
                yield pa.RecordBatch.from_arrays([*part.columns, *told.values()], names=[*names, *told])

        return back(docs.mapInArrow(tidy(run), schema))

    # Numbered and written once, so that all shards speak of the same rows.
    docs = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    hits = None
    for items in itertools.chain((first, second), every):
        shared = spark.sparkContext.broadcast(SuffixAutomaton(items, window))

        def hit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, words in _split(batches, text):
                found = shared.value.hits(words)
                at = [i for i, (r, _) in enumerate(found) if r]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row").take(pa.array(at, pa.int64())), pa.array([np.array(found[i][0], "<i8").tobytes() for i in at], pa.binary()), pa.array([sorted(found[i][1]) for i in at], pa.list_(pa.string()))],
                    names=["_row", "spans", "items"],
                )

        own = cut(docs.select("_row", text).mapInArrow(tidy(hit), "_row long, spans binary, items array<string>"))
        shared.unpersist()
        hits = own if hits is None else hits.unionByName(own)
    lists = hits.groupBy(F.col("_row").alias("_hit")).agg(F.collect_list("spans").alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_names"))
    met = docs.join(lists, F.col("_row") == F.col("_hit"), "left").select(*names, "_all", "_names")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _split(batches, text):
            ranges = [merged([tuple(x) for s in own or () for x in np.frombuffer(s, "<i8").reshape(-1, 2).tolist()]) for own in part.column("_all").to_pylist()]
            told = _told([len(w) for w in words], ranges, [n or [] for n in part.column("_names").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *told.values()], names=[*names, *told])

    return back(met.mapInArrow(tidy(merge), schema))


def judged(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``scan``'s columns, by the 1-in-20 rule."""
    return scanned.select(
        F.col(id_col).alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", share: int = 20, longest: int | None = None, cut_rest: bool = False, **how) -> DataFrame:
    """``docs`` without those in which one word in ``share`` or more is hit, or whose longest hit span exceeds
    ``longest`` words (None: no such limit). ``cut_rest``: remove the hit spans from the texts that stay."""
    docs, new, back = shielded(docs)
    names, text_col = docs.columns, new[text_col]
    found = scan(docs, benchmark, text_col=text_col, **how)
    bad = (F.col("_n_hit") > 0) & (share * F.col("_n_hit") >= F.col("_n_words"))
    if longest is not None:
        bad = bad | (F.col("_longest") > longest)
    found = found.filter(~bad)
    if not cut_rest:
        return back(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            for i, s in enumerate(b.column("_spans").to_pylist()):
                if not s:
                    continue
                raw = texts[i].encode()
                at = [m.span() for m in _WORD.finditer(raw)]
                out, last = [], 0
                for x, y in np.frombuffer(s, "<i8").reshape(-1, 2).tolist():
                    out.append(raw[last : at[x][0]])
                    last = at[y - 1][1]
                texts[i] = b"".join([*out, raw[last:]]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(c).type) if c == text_col else b.column(c) for c in names], names=names)

    return back(found.mapInArrow(tidy(run), docs.schema))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document against every benchmark item."""
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) doc_id", "text")
    return judged(scan(docs, table(spark, sf_dir, "benchmark")))


ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
bk as (select item_id, ws, least(len(ws), 13) as k from b where len(ws) > 0),
iw as (select distinct item_id, k, array_to_string(ws[i:i+k-1], ' ') as g from (select item_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from bk)),
ks as (select distinct k from iw),
dw as (select doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') as g from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, ks where len(ws) >= k)),
h as (select dw.doc_id, dw.i, dw.k, iw.item_id from dw join iw on dw.k = iw.k and dw.g = iw.g),
hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by doc_id),
hi as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names from (select distinct doc_id, cast(item_id as varchar) as s from h) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join hw using (doc_id) left join hi using (doc_id)
"""
