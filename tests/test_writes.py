"""The write path: blocks of a scope against a plain fold, long scopes, a library that is there before, refusals."""

import random
import time

import numpy as np
import pytest

from engram.operators import writes
from engram.operators.ingest import RANK

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliett"]


def plain_fold(chunks):
    """A list of rows, compared one by one."""
    embed, rows, out = writes.Embedder(), [], []
    for c in chunks:
        live = [r for r in rows if r["sup"] is None]
        best, sim = None, 0.0
        if live and not c["force_new"]:
            sims = [round(float(embed(r["tokens"]) @ embed(c["tokens"])), 9) for r in live]
            best, sim = live[int(np.argmax(sims))], max(sims)
            if c["state_key"]:
                best, sim = None, -1.0
        same, near = (0.95, 0.85) if len(c["text"]) < 30 else (0.92, 0.75)
        if best is not None and sim > same and not set(c["tokens"]) - set(best["tokens"]):
            action, best["uses"] = "strengthened", best["uses"] + 1
        elif best is not None and sim > near:
            action = "merged"
            if best["text"] != c["text"]:
                rows.append(best | {"id": len(rows), "sup": best["id"], "uses": 0, "val": None, "upd": None, "to": c["ts"]})
                best.update(text=c["text"], tokens=c["tokens"], upd=c["ts"])
            if RANK.get(c["source"], 0) >= RANK.get(best["source"], 0):
                best["source"] = c["source"]
            best["response"] = c["response"] or best["response"]
            best["uses"] += 1
        else:
            action = "new"
            made = c["ts"] if c["timestamp"] is None else c["timestamp"]
            for r in rows:
                if c["state_key"] and r["key"] == c["state_key"] and r["sup"] is None:
                    r.update(sup=len(rows), to=made)
            best = {"id": len(rows), "text": c["text"], "tokens": c["tokens"], "sup": None, "uses": 0, "key": c["state_key"], "val": c["state_value"], "upd": None, "to": None, "ts": made, "source": c["source"], "response": c["response"]}
            rows.append(best)
        out.append((action, best["id"], round(1 - sim, 7)))
    return out, [(r["id"], r["text"], r["sup"], r["uses"], r["upd"], r["to"], r["ts"], r["source"], r["response"], r["key"], r["val"]) for r in rows]


def some_chunks(n, seed, words=WORDS):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = list(rng.choice(out)["tokens"])
            if rng.random() < 0.6:
                w = w + [rng.choice(words) + str(rng.randint(0, 3))]
        else:
            w = [rng.choice(words) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 8))]
        key = rng.choice([None] * 8 + ["k1", "k2"])
        text = " ".join(w) + ("" if rng.random() < 0.7 else "!")
        out.append({"text": text, "tokens": sorted(set(w)), "ts": float(i), "timestamp": rng.choice([None, None, -float(i)]), "source": rng.choice(["auto", "hook", "import", "model", "odd"]), "response": rng.choice(["", "yes"]), "tags": None,
                    "compartment": None, "force_new": rng.random() < 0.1, "state_key": key, "state_value": key and str(i)})
    return out


def folded(chunks, block, monkeypatch=None):
    scope = writes.Scope([], writes.Embedder())
    done = [(o["action"], o["memory_id"], round(o["novelty"], 7)) for o in scope.write(chunks)]
    return done, [(r["memory_id"], r["text"], r["superseded_by"], r["access_count"], r["updated_at"], r["valid_to"], r["ts"], r["source"], r["response"], r["state_key"], r["state_value"]) for r in scope.rows]


@pytest.mark.parametrize("block", [1, 7, 128])
@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_a_fold(monkeypatch, block, seed):
    monkeypatch.setattr(writes, "BLOCK", block)
    chunks = some_chunks(400, seed)
    got, want = folded(chunks, block), plain_fold(chunks)
    assert got == want
    assert {a for a, _, _ in got[0]} == {"new", "merged", "strengthened"}


def test_a_long_scope():
    words = [f"w{i}" for i in range(3000)]
    chunks = some_chunks(20_000, 9, words)
    start = time.perf_counter()
    done = list(writes.Scope([], writes.Embedder()).write(chunks))
    assert len(done) == 20_000 and time.perf_counter() - start < 120


def requests(spark, rows):
    names = list(writes.REQUEST)
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"{c} {k}" for c, k in writes.REQUEST.items()))


def some_requests(n, scopes, seed):
    return [
        {"scope": i % scopes, "seq": i, "text": c["text"] + "。" + (" and more " + c["text"] if i % 5 == 0 else ""), "response": c["response"], "tags": ["t"], "source": c["source"], "ts": c["ts"], "timestamp": c["timestamp"],
         "force_new": c["force_new"], "compartment": "lab" if i % 2 else None, "state_key": " User.K " if c["state_key"] else None, "state_value": c["state_value"]}
        for i, c in enumerate(some_chunks(n, seed))
    ]


def test_a_library_that_is_there_before(spark):
    rows = some_requests(120, 3, 11)
    whole = writes.remember(requests(spark, rows))
    first = writes.remember(requests(spark, rows[:70]))
    second = writes.remember(requests(spark, rows[70:]), writes.entries(first))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(writes.entries(second)) == plain(writes.entries(whole))
    assert plain(writes.outcomes(first).unionByName(writes.outcomes(second))) == plain(writes.outcomes(whole))
    tags = {tuple(r.tags) for r in writes.entries(whole).select("tags").collect()}
    assert tags == {("t",), ("t", "comp:lab")}
    active = [r for r in writes.entries(whole).collect() if r.state_key and r.superseded_by is None]
    assert len({(r.scope, r.state_key) for r in active}) == len(active)  # one active row of a key


def test_refusals(spark):
    rows = [
        {"scope": 1, "seq": 1, "text": "the github_pat_11ABC is here, keep it", "ts": 1.0, "source": "hook"},
        {"scope": 1, "seq": 2, "text": None, "ts": 1.0, "source": "hook"},
        {"scope": 1, "seq": 3, "text": "──── ════ ────", "ts": 1.0, "source": "hook"},
        {"scope": 1, "seq": 4, "text": "the first fact is here。 the second fact is there。", "ts": 1.0, "source": "hook", "state_key": "a.b"},
        {"scope": 2, "seq": 5, "text": "the only fact", "ts": 1.0, "source": "hook", "state_key": "A.B "},
    ]
    folded_ = writes.remember(requests(spark, rows))
    got = {r.seq: (r.action, r.reason, r.memory_ids) for r in writes.requests_done(writes.outcomes(folded_)).collect()}
    assert got == {1: ("rejected", "credential", []), 2: ("rejected", "empty", []), 3: ("rejected", "empty", []), 4: ("rejected", "keyed_chunks", []), 5: ("new", None, [0])}
    assert [(r.scope, r.memory_id, r.state_key) for r in writes.entries(folded_).collect()] == [(2, 0, "a.b")]


def test_no_requests(spark):
    assert writes.remember(requests(spark, [])).count() == 0


def plain_log(steps):
    """Operations one by one over a dict of rows; remembered texts by the plain fold's rules."""
    embed, rows, out, following = writes.Embedder(), {}, [], 0

    def add(row):
        nonlocal following
        rows[following] = row | {"id": following, "evidence": []}
        following += 1
        return following - 1

    def write(c, forced):
        live = [r for r in rows.values() if r["sup"] is None]
        best, sim = None, 0.0
        if live and not forced:
            sims = [round(float(embed(r["tokens"]) @ embed(c["tokens"])), 9) for r in live]
            best, sim = live[int(np.argmax(sims))], max(sims)
        same, near = (0.95, 0.85) if len(c["text"]) < 30 else (0.92, 0.75)
        if best is not None and sim > same and not set(c["tokens"]) - set(best["tokens"]):
            return best["id"]
        if best is not None and sim > near:
            if best["text"] != c["text"]:
                add({"text": best["text"], "tokens": best["tokens"], "sup": best["id"]})
                best.update(text=c["text"], tokens=c["tokens"])
            return best["id"]
        return add({"text": c["text"], "tokens": c["tokens"], "sup": None})

    for s in steps:
        op = s["op"]
        if op == "remember":
            out.append((op, "ok", [write(s, False)]))
        elif op == "supersede":
            a, b = s["old_id"], s["new_id"]
            chain, at = [], b
            while at in rows and at not in chain:
                chain.append(at)
                at = rows[at]["sup"]
            if a == b:
                reason = "same"
            elif a not in rows or b not in rows:
                reason = "unknown"
            elif a in chain or at == a:
                reason = "cycle"
            elif rows[b]["sup"] is not None:
                reason = "new_superseded"
            else:
                reason = "ok"
                rows[a]["sup"] = b
            out.append((op, reason, []))
        elif op == "consolidate":
            ids = sorted(set(s["memory_ids"]))
            if len(ids) < 2 or any(i not in rows for i in ids):
                out.append((op, "too_few" if len(ids) < 2 else "unknown", []))
            else:
                made = write(s, True)
                rows[made]["evidence"] = ids
                out.append((op, "ok", [made]))
        elif op == "forget":
            gone = rows.pop(s["asked_id"], None)
            for r in rows.values():
                r["evidence"] = [x for x in r["evidence"] if x != s["asked_id"]]
            out.append((op, "ok" if gone else "unknown", []))
        else:
            out.append((op, "unknown_operation", []))
    return out, [(r["id"], r["text"], r["sup"], r["evidence"]) for r in rows.values()]


def some_log(n, seed):
    rng = random.Random(seed)
    texts = [c for c in some_chunks(2 * n, seed) if len(c["text"]) > 9]
    out = []
    for i in range(n):
        op = rng.choice(["remember"] * 6 + ["supersede"] * 3 + ["consolidate", "forget", "odd"])
        top = max(3, i // 2)
        c = texts[i]
        out.append({"op": op, "text": c["text"], "tokens": c["tokens"], "chunk": c["text"], "ts": float(i), "timestamp": None, "source": "model", "response": "", "tags": None, "compartment": None, "force_new": False, "state_key": None, "state_value": None, "refused": None,
                    "old_id": rng.randint(0, top), "new_id": rng.randint(0, top), "memory_ids": [rng.randint(0, top) for _ in range(rng.randint(1, 3))], "asked_id": rng.randint(0, top)})
    return out


@pytest.mark.parametrize("seed", range(6))
def test_log_is_a_serial_fold(monkeypatch, seed):
    monkeypatch.setattr(writes, "BLOCK", 5)
    steps = some_log(300, seed)
    scope = writes.Scope([], writes.Embedder())
    got = [(s["op"], o["reason"], o["memory_ids"]) for s, o in zip(steps, scope.replay([[s] for s in steps]), strict=True)]
    want, rows = plain_log(steps)
    assert got == want
    assert [(r["memory_id"], r["text"], r["superseded_by"], r.get("evidence_ids") or []) for r in scope.rows if not r.get("gone")] == rows
    assert {r for _, r, _ in got} >= {"ok", "unknown", "new_superseded"}


def test_cycles_are_refused():
    scope = writes.Scope([], writes.Embedder())
    list(scope.write(some_chunks(8, 1)[:3] + [c | {"force_new": True, "state_key": None} for c in some_chunks(8, 2)]))
    a, b, c = [r["memory_id"] for r in scope.rows if r["superseded_by"] is None][:3]
    assert [scope.supersede(a, b, 1.0), scope.supersede(b, a, 1.0), scope.supersede(b, c, 1.0), scope.supersede(c, a, 1.0), scope.supersede(a, b, 1.0), scope.supersede(a, c, 1.0)] == ["ok", "cycle", "ok", "cycle", "new_superseded", "ok"]


def test_log_as_a_table(spark):
    names = ["scope", "seq", "op", "text", "ts", "old_id", "new_id", "memory_ids", "memory_id"]
    log = [
        (1, 1, "remember", "the sky over the port is grey", 1.0, None, None, None, None), (1, 2, "remember", "rain is due in the evening", 2.0, None, None, None, None),
        (1, 3, "consolidate", "wet weather is ahead of us", 3.0, None, None, [1, 0], None), (1, 4, "supersede", None, 4.0, 0, 1, None, None), (1, 5, "forget", None, 5.0, None, None, None, 0),
        (1, 6, "consolidate", "hf_secret holds", 6.0, None, None, [1, 2], None), (1, 7, "supersede", None, 7.0, None, 2, None, None), (2, 1, "remember", None, 1.0, None, None, None, None), (2, 2, None, None, 1.0, None, None, None, None),
    ]
    done, library = writes.replay(spark.createDataFrame(log, "scope long, seq long, op string, text string, ts double, old_id long, new_id long, memory_ids array<long>, memory_id long").select(*names))
    assert [(r.scope, r.seq, r.ok, r.reason, r.memory_ids) for r in done.orderBy("scope", "seq").collect()] == [
        (1, 1, True, "ok", [0]), (1, 2, True, "ok", [1]), (1, 3, True, "ok", [2]), (1, 4, True, "ok", []), (1, 5, True, "ok", []), (1, 6, False, "credential", []), (1, 7, False, "unknown", []),
        (2, 1, False, "empty", []), (2, 2, False, "unknown_operation", []),
    ]
    assert [(r.memory_id, r.superseded_by, r.evidence_ids) for r in library.orderBy("memory_id").collect()] == [(1, None, []), (2, None, [1])]
    more, after = writes.replay(spark.createDataFrame([(1, 9, "forget", 1)], "scope long, seq long, op string, memory_id long"), library)
    assert [(r.memory_id, r.evidence_ids) for r in after.collect()] == [(2, [])] and more.first().ok


def test_a_block_is_embedded_at_once(monkeypatch):
    """One embedding for a block of chunks, and the rows it changes are compared by the block's own similarities."""
    calls = []
    plain = writes.Embedder.block
    monkeypatch.setattr(writes.Embedder, "block", lambda self, texts: calls.append(len(texts)) or plain(self, texts))
    words = [[f"w{i % 7}", f"w{i % 11}", "same"] for i in range(300)]
    chunks = [{"text": " ".join(w) + " of some length", "tokens": sorted(set(w)), "response": "", "tags": [], "source": "auto", "ts": float(i), "timestamp": None, "force_new": i % 13 == 0, "compartment": None, "state_key": None, "state_value": None} for i, w in enumerate(words)]
    done = list(writes.Scope([], writes.Embedder()).write(chunks))
    assert calls == [128, 128, 44] and len(done) == 300
    monkeypatch.setattr(writes, "BLOCK", 1)
    assert done == list(writes.Scope([], writes.Embedder()).write(chunks))
