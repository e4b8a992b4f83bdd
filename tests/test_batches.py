"""Capture batches against a plain cascade, and the block's budget."""

import math
import random

from pyspark.sql import functions as F

from engram.operators import batches

ENTRY = "memory_id long, text string, ts double, tags array<string>, superseded_by long"


def some_entries(n, seed):
    rng = random.Random(seed)
    return [(i, "  " + " ".join(rng.choice(["red", "green", "blue"]) for _ in range(rng.randint(0, 60))) + "\n", float(rng.choice([rng.randint(0, 4000), rng.randint(50_000, 300_000)])), rng.choice([["app:a"], ["comp:x", "app:b", "app:a"], [], ["app:c"]]), rng.choice([None, None, None, 3])) for i in range(n)]


def app(tags):
    return next((t[4:] for t in tags if t.startswith("app:")), "")


def plain_members(entries, key, window, cap):
    name, bucket = key
    for wide in (1, 6, 24):
        span = window * wide
        found = [e for e in entries if e[4] is None and app(e[3]) == name and math.floor(e[2] / span) == math.floor(bucket * window / span)]
        if len(found) >= 2:
            found.sort(key=lambda e: (abs(e[2] - (bucket + 0.5) * window), e[0]))
            return [(name, bucket, wide, e[0], k) for k, e in enumerate(found[:cap], 1)]
    return []


def test_members_by_the_cascade(spark):
    entries = some_entries(260, 1)
    keys = sorted({(app(e[3]), math.floor(e[2] / 300)) for e in entries}) + [("none", 4)]
    got = batches.batch_members(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(keys, "app string, key long"), 300.0, 5, parts=3).collect()
    want = [m for k in keys for m in plain_members(entries, k, 300.0, 5)]
    assert sorted((r.app, r.key, r.wide, r.memory_id, r.rank) for r in got) == sorted(want)
    assert {r.wide for r in got} == {1, 6, 24}


def test_keys_of_hits(spark):
    hits = [(1, "a", 10.0, 0.5, 1), (1, "a", 200.0, 0.9, 2), (1, "b", 10.0, 0.9, 3), (1, "a", 900.0, 0.2, 4), (1, "c", 1.0, 0.1, 5), (2, "", -5.0, 0.3, 1)]
    got = batches.batch_keys(spark.createDataFrame(hits, "query_id long, app string, ts double, sim double, rank int"), 300.0).collect()
    assert sorted((r.query_id, r.place, r.app, r.key, r.best) for r in got) == [(1, 1, "a", 0, 0.9), (1, 2, "b", 0, 0.9), (1, 3, "a", 3, 0.2), (2, 1, "", -1, 0.3)]


def plain_block(entries, hits, budget, share, window):
    by = {e[0]: e for e in entries}
    used, pieces = 0, []
    for i, sim in hits:
        body = (by[i][1] or "").strip()
        body = body[:79] + "…" if len(body) > 80 else body
        names = [t[4:] for t in by[i][3] if t.startswith("app:")]
        piece = f"[#{i} | {sim:.2f} | app={'+'.join(names) or 'legacy'} | just now (01-{1 + int(by[i][2] // 86400):02})]\n{body}"
        if used + len(piece) + 2 <= max(400, int(budget * (1 - share))):
            pieces.append(piece)
            used += len(piece) + 2
    best = {}
    for i, sim in hits:
        k = (app(by[i][3]), math.floor(by[i][2] / window))
        best[k] = max(best.get(k, -9), sim)
    keys = sorted(best.items(), key=lambda x: -x[1])[:3]
    out, n = [f"top_sim={hits[0][1]:.2f}", "\n\n".join([f"[memory block: {len(pieces)} entries, {used} chars]", *pieces])], 0
    for k, _ in keys if share else []:
        members = plain_members(entries, k, window, 20)
        if members:
            n += 1
            first = by[members[0][3]][2]
            stamp = f"1970-01-{1 + int(first // 86400):02} {int(first % 86400 // 3600):02}:{int(first % 3600 // 60):02}"
            body = "\n".join(by[m[3]][1] for m in members)[: max(300, int(budget * share) // len(keys))]
            out.append(f"[capture batch {stamp} · {len(members)} entries]\n{body}")
    return len(pieces), used, n, "\n".join(out)


def test_block_shares_its_budget(spark):
    entries = some_entries(120, 2)
    rng = random.Random(3)
    asks = {q: [(i, round(0.9 - 0.07 * k, 3)) for k, i in enumerate(rng.sample(range(120), 9))] for q in range(4)}
    hits = spark.createDataFrame([(q, i, s, k) for q, h in asks.items() for k, (i, s) in enumerate(h, 1)], "query_id long, memory_id long, sim double, rank int")
    df = spark.createDataFrame(entries, ENTRY).withColumn("ts", F.col("ts"))
    for share in (0.4, 0.0):
        got = {r.query_id: (r.taken, r.used, r.parents, r.block) for r in batches.recall_block(df, hits, 0.0, budget=1500, per_entry=80, share=share, window=300.0).collect()}
        assert got == {q: plain_block(entries, h, 1500, share, 300.0) for q, h in asks.items()}
