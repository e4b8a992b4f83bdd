"""The write path: chunk, gate, then the sequential dedup ladder.

Each chunk is compared with the rows written before it, so the fold is sequential by definition. It runs in
parallel over independent partitions (``scope``, e.g. a conversation or compartment), each held as arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RANK = {"auto": 0, "hook": 1, "import": 2, "model": 3}
DIMS = 256


def hash_embedding(words: list[str], dims: int = DIMS) -> np.ndarray:
    """Offline embedder: each word counts in three hashed dimensions; only counted dimensions are set."""
    v = np.zeros(dims)
    for w in words:
        d = hashlib.md5(w.encode()).digest()
        for i in range(3):
            v[int.from_bytes(d[4 * i : 4 * i + 4], "little") % dims] += 1
    return v / (np.linalg.norm(v) + 1e-9)


def ladder(chunks: list[dict], embed=hash_embedding) -> list[dict]:
    """Fold chunks (text, tokens, source, ts, state_key) into entries with ids from 0; returns one outcome per chunk.

    Very similar without new tokens: strengthened. Similar: merged, the old text kept as a superseded
    tombstone under a new id if the text differs. Else new. A keyed chunk is always new and supersedes older active rows of its key;
    a chunk with ``force_new`` is always new. The novelty is 1 less the highest similarity to a live entry.
    """
    rows: list[dict] = []
    outcomes = []
    for c in chunks:
        e = embed(c["tokens"])
        live = [r for r in rows if r["superseded_by"] is None]
        # Without a live entry, or where a write is forced, nothing is looked for: the novelty is 1. A keyed chunk beside live
        # entries is never like any of them: its novelty is 2.
        best, sim = None, 0.0
        if live and not c.get("force_new"):
            sim = -1.0
            if not c.get("state_key"):
                sims = np.array([r["embedding"] @ e for r in live])
                best, sim = live[int(sims.argmax())], float(sims.max())
        same, near = (0.95, 0.85) if len(c["text"]) < 30 else (0.92, 0.75)
        if best is not None and sim > same and not set(c["tokens"]) - set(best["tokens"]):
            best["access_count"] += 1
            best["last_accessed"] = c["ts"]
            action, target = "strengthened", best
        elif best is not None and sim > near:
            if c["text"] != best["text"]:
                rows.append(best | {"memory_id": len(rows), "superseded_by": best["memory_id"], "access_count": 0, "valid_to": c["ts"], "state_value": None})
                best.update(text=c["text"], tokens=c["tokens"], embedding=e)
            if RANK.get(c["source"], 0) >= RANK.get(best["source"], 0):
                best["source"] = c["source"]
            best["access_count"] += 1
            best["last_accessed"] = c["ts"]
            action, target = "merged", best
        else:
            target = {"memory_id": len(rows), "text": c["text"], "tokens": c["tokens"], "embedding": e, "source": c["source"], "ts": c["ts"], "last_accessed": c["ts"], "access_count": 0, "superseded_by": None, "valid_to": None, "state_key": c.get("state_key"), "state_value": None}
            for r in rows:
                if target["state_key"] and r["state_key"] == target["state_key"] and r["superseded_by"] is None:
                    r.update(superseded_by=target["memory_id"], valid_to=c["ts"])
            rows.append(target)
            action = "new"
        outcomes.append({"action": action, "memory_id": target["memory_id"], "novelty": 1 - sim})
    return outcomes


def chunked(messages: DataFrame) -> DataFrame:
    """Messages (scope, seq, text, source, ts) to admitted chunks with their tokens and reasons of refusal."""
    gated = messages.withColumn("refused", F.when(T.has_credential(F.col("text")), "credential"))
    parts = gated.select("*", F.posexplode_outer(F.when(F.col("refused").isNull(), T.chunks(F.col("text")))).alias("pos", "chunk"))
    parts = parts.withColumn("refused", F.coalesce("refused", F.when(F.col("chunk").isNull() | T.is_junk(F.col("chunk")), "junk")))
    return parts.select("scope", "seq", "pos", F.coalesce("chunk", F.lit("")).alias("text"), F.array_sort(T.tokens(F.coalesce("chunk", F.lit("")))).alias("tokens"), "source", "ts", "refused")


def remember(messages: DataFrame) -> DataFrame:
    """One outcome per chunk: (scope, seq, pos, action, memory_id, novelty); refused chunks carry their reason as action."""
    parts = chunked(messages)

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "pos"])
        done = ladder([{"text": r.text, "tokens": list(r.tokens), "source": r.source, "ts": r.ts} for r in pdf.itertuples()])
        return pd.DataFrame({"scope": pdf["scope"], "seq": pdf["seq"], "pos": pdf["pos"], **{k: [d[k] for d in done] for k in ("action", "memory_id", "novelty")}})

    schema = "scope long, seq long, pos int, action string, memory_id long, novelty double"
    kept = parts.filter("refused is null").groupBy("scope").applyInPandas(fold, schema)
    refused = parts.filter("refused is not null").selectExpr("scope", "seq", "coalesce(pos, 0) pos", "refused action", "cast(null as bigint) memory_id", "cast(null as double) novelty")
    return kept.unionByName(refused)


def rolled_up(outcomes: DataFrame) -> DataFrame:
    """Per message: the common action, or ``mixed``, or ``rejected`` if nothing was stored, with counts."""
    stored = F.col("action").isin("new", "merged", "strengthened")
    per = outcomes.groupBy("scope", "seq").agg(*(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("new", "merged", "strengthened")), F.count_if(~stored).alias("n_refused"), F.collect_set(F.when(stored, F.col("action"))).alias("_a"))
    return per.withColumn("action", F.when(F.size("_a") == 0, "rejected").when(F.size("_a") == 1, F.element_at("_a", 1)).otherwise("mixed")).drop("_a")


def novelty_gate(messages: DataFrame, least: float = 0.1, codes: bool = False) -> DataFrame:
    """(scope, seq, stored, novelty) for messages (scope, seq, text): a message is stored unless one stored before it in its scope is
    too similar. Novelty is one less the best cosine (stored from ``least`` on), or with ``codes`` the least share of code
    bits that differ (stored above ``least``); the first has novelty 1. A null text is empty."""
    parts = messages.select("scope", "seq", F.array_sort(T.tokens(F.coalesce("text", F.lit("")))).alias("tokens"))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        kept, rows = np.zeros((len(pdf), DIMS)), []
        n = 0
        for t in pdf["tokens"]:
            e = hash_embedding(list(t))
            e = (e > 0).astype(float) if codes else e
            novelty = 1.0
            if n:
                novelty = float(np.abs(kept[:n] - e).mean(axis=1).min()) if codes else 1 - float((kept[:n] @ e).max())
            stored = not n or (novelty > least if codes else novelty >= least)
            if stored:
                kept[n] = e
                n += 1
            rows.append((stored, novelty))
        return pd.DataFrame({"scope": pdf["scope"], "seq": pdf["seq"], "stored": [r[0] for r in rows], "novelty": [r[1] for r in rows]})

    return parts.groupBy("scope").applyInPandas(fold, "scope long, seq long, stored boolean, novelty double")
