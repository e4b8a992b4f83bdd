"""The write path: requests are gated, cut into chunks and folded into a library, one scope (a conversation, a compartment) after the other's rows.

Each chunk is compared with the rows before it, so a scope is a fold by definition: scopes run in parallel, one scope in one task. Its rows are one matrix,
doubled when full; chunks are compared with it in blocks, by one matrix product each, and one by one only with what their own block has changed. So a
scope of n chunks costs n / ``BLOCK`` products and n passes over a column of similarities. Similarities count to nine digits.

A request (scope, seq, text, response, tags, source, ts, timestamp, force_new, compartment, state_key, state_value) is refused whole for a credential in its text, for a
key with more than one chunk, or if no chunk is left; junk chunks are dropped. ``ts`` is the clock of the write, ``timestamp`` (null: ts) the creation time it claims.
Missing columns count as null; null texts as empty.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as T
from ..sources.shared import written
from .ingest import DIMS, RANK

BLOCK = 128
REQUEST = {
    "scope": "long", "seq": "long", "text": "string", "response": "string", "tags": "array<string>", "source": "string", "ts": "double", "timestamp": "double",
    "force_new": "boolean", "compartment": "string", "state_key": "string", "state_value": "string",
}
ENTRY = "text string, response string, source string, ts double, last_accessed double, access_count long, tags array<string>, superseded_by long, updated_at double, valid_from double, valid_to double, state_key string, state_value string"
FOLD = f"scope long, seq long, pos int, action string, memory_id long, novelty double, {ENTRY}"
_FIELDS = [x.split()[0] for x in ENTRY.split(", ")]


class Embedder:
    """The offline embedding, with each word hashed once."""

    def __init__(self) -> None:
        self.dims: dict[str, tuple] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        return self.block([words])[0]

    def block(self, texts: list[list[str]]) -> np.ndarray:
        """One row for each text; counts are whole numbers, so their order doesn't matter."""
        hit: list[int] = []
        for i, words in enumerate(texts):
            for w in words:
                at = self.dims.get(w)
                if at is None:
                    d = hashlib.md5(w.encode()).digest()
                    at = self.dims[w] = tuple(int.from_bytes(d[4 * i : 4 * i + 4], "little") % DIMS for i in range(3))
                hit += (i * DIMS + at[0], i * DIMS + at[1], i * DIMS + at[2])
        v = np.bincount(np.array(hit, np.int64), minlength=len(texts) * DIMS).reshape(-1, DIMS).astype(float)
        return v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-9)


class Scope:
    """The rows of one scope. A row's number is its place; its id follows from the first."""

    def __init__(self, rows: list[dict], embed) -> None:
        self.rows, self.embed = rows, embed
        self.next = max((r["memory_id"] for r in rows), default=-1) + 1
        self.matrix, self.live = np.zeros((max(64, len(rows)), DIMS)), np.zeros(max(64, len(rows)), bool)
        self.keyed: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            if r["superseded_by"] is None:
                self.matrix[i], self.live[i] = embed(r["tokens"]), True
                if r["state_key"]:
                    self.keyed.setdefault(r["state_key"], []).append(i)

    def place(self, memory_id: int | None) -> int | None:
        """The place of the row of an id; places ascend with ids."""
        if memory_id is None:
            return None
        i = bisect.bisect_left(self.rows, memory_id, key=lambda r: r["memory_id"])
        return i if i < len(self.rows) and self.rows[i]["memory_id"] == memory_id and not self.rows[i].get("gone") else None

    def _retire(self, i: int) -> None:
        self.live[i] = False
        key = self.rows[i]["state_key"]
        if key and i in self.keyed.get(key, []):
            self.keyed[key].remove(i)

    def supersede(self, old: int | None, new: int | None, ts: float) -> str:
        """Mark the old row's successor: ``ok``, or why not (the first that holds: same, unknown, cycle, new_superseded)."""
        a, b = self.place(old), self.place(new)
        if old == new:
            return "same"
        if a is None or b is None:
            return "unknown"
        at, seen = new, set()
        while at is not None and at not in seen:
            if at == old:
                return "cycle"
            seen.add(at)
            i = self.place(at)
            at = None if i is None else self.rows[i]["superseded_by"]
        if self.rows[b]["superseded_by"] is not None:
            return "new_superseded"
        self.rows[a].update(superseded_by=new, valid_to=ts)
        self._retire(a)
        return "ok"

    def consolidate(self, ids: list[int], chunks: list[dict]) -> tuple[str, list[int]]:
        """Forced rows for the chunks of a conclusion, each with the sorted evidence ids."""
        distinct = sorted({i for i in ids if i is not None})
        if len(distinct) < 2:
            return "too_few", []
        if any(self.place(i) is None for i in distinct):
            return "unknown", []
        if chunks[0]["refused"]:
            return chunks[0]["refused"], []
        made = [o["memory_id"] for o in self.write([c | {"force_new": True} for c in chunks])]
        for i in made:
            self.rows[self.place(i)]["evidence_ids"] = distinct
        return "ok", made

    def forget(self, memory_id: int | None) -> str:
        """Delete a row; it is no longer anybody's evidence."""
        i = self.place(memory_id)
        if i is None:
            return "unknown"
        self._retire(i)
        self.rows[i]["gone"] = True
        for r in self.rows:
            if memory_id in (r.get("evidence_ids") or []):
                r["evidence_ids"] = [x for x in r["evidence_ids"] if x != memory_id]
        return "ok"

    def replay(self, steps: list[list[dict]]) -> Iterator[dict]:
        """One outcome (ok, reason, memory_ids) for each operation, a list of chunks; runs of remembered texts are written in one go."""
        i = 0
        while i < len(steps):
            c, op = steps[i][0], steps[i][0]["op"]
            if op == "remember":
                j = i
                while j < len(steps) and steps[j][0]["op"] == "remember":
                    j += 1
                done = self.write([x for step in steps[i:j] for x in step if not x["refused"]])
                for step in steps[i:j]:
                    ids = [next(done)["memory_id"] for x in step if not x["refused"]]
                    yield {"ok": bool(ids), "reason": step[0]["refused"] or "ok", "memory_ids": ids}
                for _ in done:  # to the end: what the last block has changed is kept
                    pass
                i = j
                continue
            made: list[int] = []
            if op == "supersede":
                reason = self.supersede(c["old_id"], c["new_id"], c["ts"])
            elif op == "consolidate":
                reason, made = self.consolidate(c["memory_ids"] or [], steps[i])
            elif op == "forget":
                reason = self.forget(c["asked_id"])
            else:
                reason = "unknown_operation"
            yield {"ok": reason == "ok", "reason": reason, "memory_ids": made}
            i += 1

    def _add(self, row: dict, live: bool) -> int:
        i = len(self.rows)
        if i == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.live = np.concatenate([self.live, np.zeros_like(self.live)])
        self.rows.append(row | {"memory_id": self.next})
        self.next += 1
        self.live[i] = live
        return i

    def write(self, chunks: list[dict]) -> Iterator[dict]:
        """One outcome (action, memory_id, novelty) for each chunk, in order."""
        for low in range(0, len(chunks), BLOCK):
            block = chunks[low : low + BLOCK]
            vectors = self.embed.block([c["tokens"] for c in block])
            n = len(self.rows)
            sims = np.where(self.live[:n, None], np.round(self.matrix[:n] @ vectors.T, 9), -np.inf)
            fresh: dict[int, int] = {}  # rows that are new or rewritten since, and their places in ``now``
            # The vector of such a row is one of the block's, so its similarities to the chunks are known: a row of ``alike``, or nothing where it is no longer live.
            alike = np.round(vectors @ vectors.T, 9)
            now, source = np.full((len(block), len(block)), -np.inf), np.zeros(len(block), np.int64)
            numbers = np.zeros(len(block), np.int64)
            for j, c in enumerate(block):
                best, sim = self._nearest(sims[:, j], now[: len(fresh), j], numbers) if not c["force_new"] else (None, 0.0)
                if best is not None and c["state_key"]:
                    best, sim = None, -1.0
                changed = None
                same, near = (0.95, 0.85) if len(c["text"]) < 30 else (0.92, 0.75)
                row = None if best is None else self.rows[best]
                if row is not None and sim > same and not set(c["tokens"]) - set(row["tokens"]):
                    action = "strengthened"
                elif row is not None and sim > near:
                    action = "merged"
                    if c["text"] != row["text"]:
                        since = row["valid_from"] or row["ts"]
                        self._add(row | {"access_count": 0, "superseded_by": row["memory_id"], "valid_from": since, "valid_to": c["ts"], "state_value": None, "updated_at": None, "evidence_ids": []}, False)
                        row.update(text=c["text"], tokens=c["tokens"], updated_at=c["ts"])
                        changed = best
                    if RANK.get(c["source"], 0) >= RANK.get(row["source"], 0):
                        row["source"] = c["source"]
                    if c["response"]:
                        row["response"] = c["response"]
                else:
                    action = "new"
                    made = c["ts"] if c["timestamp"] is None else c["timestamp"]
                    tags = list(c["tags"] or []) + ([f"comp:{c['compartment']}"] if c["compartment"] else [])
                    changed = self._add(
                        {"text": c["text"], "tokens": c["tokens"], "response": c["response"] or "", "source": c["source"], "ts": made, "last_accessed": made, "access_count": 0, "tags": tags, "superseded_by": None,
                         "updated_at": None, "valid_from": made, "valid_to": None, "state_key": c["state_key"], "state_value": c["state_value"]}, True)
                    row = self.rows[changed]
                    if c["state_key"]:
                        for i in self.keyed.get(c["state_key"], []):
                            self.rows[i].update(superseded_by=row["memory_id"], valid_to=made)
                            self.live[i] = False
                            if i in fresh:
                                now[fresh[i]] = -np.inf
                            if i < n:
                                sims[i] = -np.inf
                        self.keyed[c["state_key"]] = [changed]
                if action != "new":
                    row["access_count"] += 1
                    row["last_accessed"] = c["ts"]
                if changed is not None:
                    if changed < n:
                        sims[changed] = -np.inf
                    at = fresh.setdefault(changed, len(fresh))
                    now[at], source[at], numbers[at] = alike[j], j, changed
                yield {"action": action, "memory_id": row["memory_id"], "novelty": 1 - sim}
            for i, at in fresh.items():
                self.matrix[i] = vectors[source[at]]

    @staticmethod
    def _nearest(old: np.ndarray, now: np.ndarray, numbers: np.ndarray) -> tuple[int | None, float]:
        """The live row of the highest similarity, of equal ones the earliest, and that similarity. ``old``: by place; ``now``: those of ``numbers``."""
        best, sim = None, -np.inf
        if len(old):
            best = int(old.argmax())
            sim = float(old[best])
        if len(now):
            top = float(now.max())
            if top >= sim and top > -np.inf:
                first = int(numbers[: len(now)][now == top].min())
                if top > sim or first < best:
                    best, sim = first, top
        return (None, 0.0) if sim == -np.inf else (best, sim)


def chunked(requests: DataFrame) -> DataFrame:
    """Requests as chunks with pos, chunk, tokens and n (chunks of the request), and with ``refused``: credential, keyed_chunks or empty (pos 0, no chunk)."""
    more = [c for c in requests.columns if c not in REQUEST]
    rows = requests.select(*((F.col(c) if c in requests.columns else F.lit(None)).cast(kind).alias(c) for c, kind in REQUEST.items()), *more)
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("state_key", T.state_key(F.col("state_key")))
    rows = rows.withColumn("chunks", F.when(T.has_credential(F.col("text")), F.lit(None)).otherwise(F.filter(T.chunks(F.col("text")), lambda c: ~T.is_junk(c))))
    n = F.size("chunks")
    refused = F.when(F.col("chunks").isNull(), "credential").when(n == 0, "empty").when(F.col("state_key").isNotNull() & (n > 1), "keyed_chunks")
    rows = rows.withColumn("refused", refused)
    kept = rows.select("*", F.posexplode_outer(F.when(F.col("refused").isNull(), F.col("chunks"))).alias("pos", "chunk"))
    return kept.withColumn("pos", F.coalesce("pos", F.lit(0))).withColumn("tokens", F.array_sort(T.tokens(F.coalesce("chunk", F.lit(""))))).drop("chunks", "text")


def _by_scope(parts: DataFrame, library: DataFrame, fold, schema: str) -> DataFrame:
    """``fold(scope, entries, chunks)``, rows as dictionaries in order, for each scope; what it returns, rows as dictionaries, written once.

    Rows are dealt out by scope and sorted within the partitions; a task reads one scope after the other and holds one at a time.
    """
    out = to_arrow_schema(T_.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for scope, rows in itertools.groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["scope"]):
            there, chunks = [], []
            for r in rows:
                if r["kind"]:
                    chunks.append(r | {"text": r["chunk"], "tokens": r["tokens"] or [], "force_new": bool(r["force_new"])})
                else:
                    there.append(r | {"access_count": r["access_count"] or 0, "tags": r["tags"] or [], "tokens": r["tokens"] or []})
            held += [{"scope": scope} | x for x in fold(there, chunks)]
            while len(held) >= 5000:
                yield pa.RecordBatch.from_pylist(held[:5000], schema=out)
                held = held[5000:]
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=out)

    both = parts.withColumn("kind", F.lit(1)).unionByName(library.withColumn("kind", F.lit(0)).withColumn("seq", F.col("memory_id")), allowMissingColumns=True)
    return both.repartition("scope").sortWithinPartitions("scope", "kind", "seq", "pos").mapInArrow(run, schema)


def remember(requests: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """The fold over requests, written once: one row for each chunk or refused request (seq and action set), one for each entry of the library
    after it (seq null). ``library``: entries (scope, memory_id, …) that are there before."""
    parts = written(chunked(requests))  # a filter on what became of a request would cut its text anew for each column it looks at

    def fold(there: list[dict], chunks: list[dict]) -> list[dict]:
        scope = Scope(there, Embedder())
        out = [{"seq": c["seq"], "pos": c["pos"]} | o for c, o in zip(chunks, scope.write(chunks), strict=True)]
        return out + [{"memory_id": r["memory_id"]} | {k: r[k] for k in _FIELDS} for r in scope.rows]

    kept = parts.filter("refused is null").select("scope", "seq", "pos", "chunk", "tokens", "response", "tags", "source", "ts", "timestamp", "force_new", "compartment", "state_key", "state_value")
    if library is None:
        library = requests.sparkSession.createDataFrame([], f"scope long, memory_id long, {ENTRY}")
    library = library.select("scope", "memory_id", *_FIELDS).withColumn("tokens", F.array_sort(T.tokens(F.coalesce("text", F.lit("")))))
    done = _by_scope(kept, library, fold, FOLD)
    none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in ENTRY.split(", ")]
    turned = parts.filter("refused is not null").select("scope", "seq", F.col("pos").cast("int").alias("pos"), F.col("refused").alias("action"), F.lit(None).cast("long").alias("memory_id"), F.lit(0.0).alias("novelty"), *none)
    return written(done.unionByName(turned))


def outcomes(folded: DataFrame) -> DataFrame:
    """(scope, seq, pos, action, memory_id, novelty): new, merged or strengthened, or why a request was refused."""
    return folded.filter("seq is not null").select("scope", "seq", "pos", "action", "memory_id", "novelty")


def entries(folded: DataFrame) -> DataFrame:
    """The library after the fold: (scope, memory_id, …)."""
    return folded.filter("seq is null").drop("seq", "pos", "action", "novelty")


def requests_done(done: DataFrame) -> DataFrame:
    """For each request (scope, seq): the common action, ``mixed`` or ``rejected`` with its reason; counts; the ids touched, in order; the last novelty."""
    kinds = ("new", "merged", "strengthened")
    stored = F.col("action").isin(*kinds)
    last: Column = F.max_by("novelty", "pos")
    per = done.groupBy("scope", "seq").agg(
        *(F.count_if(F.col("action") == k).alias(k) for k in kinds), F.collect_set(F.when(stored, F.col("action"))).alias("_kinds"), F.max(F.when(~stored, F.col("action"))).alias("reason"),
        F.transform(F.array_sort(F.collect_list(F.when(stored, F.struct("pos", "memory_id")))), lambda x: x["memory_id"]).alias("memory_ids"), last.alias("novelty"),
    )
    action = F.when(F.size("_kinds") == 0, "rejected").when(F.size("_kinds") == 1, F.col("_kinds")[0]).otherwise("mixed")
    return per.select("scope", "seq", action.alias("action"), "reason", *kinds, "memory_ids", "novelty")


LOG = {"op": "string", "old_id": "long", "new_id": "long", "memory_ids": "array<long>", "memory_id": "long"}


def replay(log: DataFrame, library: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A mixed log, replayed scope by scope in the order of seq: remember (text), supersede (old_id, new_id), consolidate (memory_ids, text), forget
    (memory_id), with the other columns of a request. Returns (scope, seq, op, ok, reason, memory_ids) and the library after it, with evidence_ids.

    What can't be done is a row with its reason and changes nothing. Ids are those of the scope: the library's, then on from its largest; a forgotten
    id isn't given again. ``library``: entries (scope, memory_id, …), with or without evidence_ids.
    """
    rows = log.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in LOG.items() if c not in log.columns))
    parts = written(chunked(rows.withColumn("state_key", F.lit(None).cast("string")).withColumn("source", F.coalesce("source", F.lit("model")) if "source" in rows.columns else F.lit("model"))))

    def fold(there: list[dict], chunks: list[dict]) -> list[dict]:
        scope = Scope(there, Embedder())
        steps = [list(x) for _, x in itertools.groupby(chunks, key=lambda c: c["seq"])]
        out = [{"seq": step[0]["seq"], "op": step[0]["op"]} | o for step, o in zip(steps, scope.replay(steps), strict=True)]
        return out + [{"memory_id": r["memory_id"], "evidence_ids": r.get("evidence_ids") or []} | {k: r[k] for k in _FIELDS} for r in scope.rows if not r.get("gone")]

    have = log.sparkSession.createDataFrame([], f"scope long, memory_id long, {ENTRY}") if library is None else library
    if "evidence_ids" not in have.columns:
        have = have.withColumn("evidence_ids", F.array().cast("array<long>"))
    have = have.select("scope", "memory_id", "evidence_ids", *_FIELDS).withColumn("tokens", F.array_sort(T.tokens(F.coalesce("text", F.lit("")))))
    schema = f"scope long, seq long, op string, ok boolean, reason string, memory_ids array<long>, memory_id long, evidence_ids array<long>, {ENTRY}"
    asked = parts.withColumnRenamed("memory_id", "asked_id")
    done = written(_by_scope(asked, have, fold, schema))
    return done.filter("seq is not null").select("scope", "seq", "op", "ok", "reason", "memory_ids"), done.filter("seq is null").select("scope", "memory_id", "evidence_ids", *_FIELDS)
