"""Streams: keyed state with back-dated rows, lateness, expiry and time to live; the capture loop and its replay; places in an order."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import order
from engram.operators.ingest import hash_embedding
from engram.sources import shared
from engram.streaming import loop, state

WRITE = "state_key string, memory_id long, arrival long, ts double"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every micro-batch has a task and a state store for each partition."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def files(spark, folder, batches, schema):
    """One file for each batch, as a stream that takes one file at a time, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(df):
    return sorted((r.state_key, r.memory_id, r.superseded_by, r.valid_to, r.status) for r in df.collect())


def plain(writes, idle=None, mark=None):
    """Writes one by one: by arrival, expired where a key was idle."""
    last, out = {}, {}
    for key, i, _, ts in sorted(writes, key=lambda w: w[2]):
        if key is None:
            continue
        if key in last:
            j, then = last[key]
            if idle is not None and ts >= then + idle:
                out[j] = (key, j, None, then + idle, "expired")
            else:
                out[j] = (key, j, i, ts, "replaced")
        last[key] = (i, ts)
        out[i] = (key, i, None, None, "active")
    for key, (j, then) in last.items():
        if idle is not None and then + idle <= mark:
            out[j] = (key, j, None, then + idle, "expired")
    return sorted(out.values())


def some_writes(n, seed, step=40.0):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "c", "hot", "hot", None]), i, i, 1000.0 + i * step - (rng.choice([0, 0, 0, 500.0]))) for i in range(n)]


@pytest.mark.parametrize("cuts", [(60,), (7, 30, 60)])
def test_active_unique_by_arrival(spark, tmp_path, cuts):
    writes = some_writes(60, 1)
    batches = [writes[a:b] for a, b in zip((0, *cuts), cuts)]
    got = state.resolved(state.drained(state.active_unique(files(spark, f"{tmp_path}/in", batches, WRITE)), f"{tmp_path}/out"))
    assert rows_of(got) == plain(writes)


@pytest.mark.parametrize("cuts", [(60,), (20, 21, 45, 60)])
def test_idle_keys_expire_however_the_stream_is_cut(spark, tmp_path, cuts):
    writes = some_writes(55, 2) + [("late", 55 + i, 55 + i, 9000.0 + i) for i in range(5)]
    batches = [writes[a:b] for a, b in zip((0, *cuts), cuts)]
    stream = state.active_unique(files(spark, f"{tmp_path}/in", batches, WRITE), late="4000 seconds", idle=300.0)
    assert rows_of(state.resolved(state.drained(stream, f"{tmp_path}/out"))) == plain(writes, 300.0, 9004.0 - 4000)


def test_rows_behind_the_watermark_are_refused_only_on_request(spark, tmp_path):
    batches = [[("k", 1, 1, 10_000.0)], [("k", 2, 2, 10_001.0)], [("k", 3, 3, 500.0)]]
    kept = state.resolved(state.drained(state.active_unique(files(spark, f"{tmp_path}/a", batches, WRITE)), f"{tmp_path}/oa"))
    assert [r[1:] for r in rows_of(kept)] == [(1, 2, 10_001.0, "replaced"), (2, 3, 500.0, "replaced"), (3, None, None, "active")]
    late = state.resolved(state.drained(state.active_unique(files(spark, f"{tmp_path}/b", batches, WRITE), late="10 seconds"), f"{tmp_path}/ob"))
    assert [r[1:] for r in rows_of(late)] == [(1, 2, 10_001.0, "replaced"), (2, None, None, "active")]


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    writes = some_writes(30, 3)
    stream = state.active_unique(files(spark, f"{tmp_path}/in", [writes[:20]], WRITE))
    assert rows_of(state.resolved(state.drained(stream, f"{tmp_path}/out"))) == plain(writes[:20])
    again = rows_of(state.resolved(state.drained(stream, f"{tmp_path}/out")))
    assert again == plain(writes[:20])  # nothing new, nothing twice
    stream = state.active_unique(files(spark, f"{tmp_path}/in", [writes[20:]], WRITE))
    assert rows_of(state.resolved(state.drained(stream, f"{tmp_path}/out"))) == plain(writes)


def test_state_is_forgotten_after_its_time_to_live(spark, tmp_path):
    make = lambda rows: state.active_unique(files(spark, f"{tmp_path}/in", [rows], WRITE), ttl=0.5)
    state.drained(make([("k", 1, 1, 1.0)]), f"{tmp_path}/out", one_batch=True)
    time.sleep(1.0)
    got = state.drained(make([("k", 2, 2, 2.0)]), f"{tmp_path}/out", one_batch=True)
    assert sorted(r.change for r in got.collect()) == ["opened", "opened"]  # the first was no longer known
    with pytest.raises(ValueError):
        state.active_unique(spark.createDataFrame([], WRITE), ttl=1.0, idle=1.0)


def test_places_before(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1.0, 2.0, 5.5]), i, rng.random() < 0.5) for i in range(200)]
    got = order.before(spark.createDataFrame(rows, "ts double, id long, c boolean"), ["ts", "id"], F.col("c")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want, n = {}, 0
    for r in sorted(rows, key=key):
        want[r[1]] = n
        n += r[2]
    assert {r.id: r.before for r in got} == want
    assert order.before(spark.createDataFrame([], "ts double"), ["ts"]).count() == 0


def test_latest_before(spark):
    rng = random.Random(5)
    items = [(i, float(rng.randint(0, 300))) for i in range(150)]
    asks = [(1000 + i, float(rng.randint(0, 320))) for i in range(40)]
    got = order.latest_before(spark.createDataFrame(items, "memory_id long, ts double"), spark.createDataFrame(asks, "query_id long, ts double"), 4, 20.0)
    want = []
    for q, at in asks:
        seen = sorted(((ts, i) for i, ts in items if ts < at), reverse=True)[:4]
        want += [(q, i, k) for k, (ts, i) in enumerate(seen, 1) if ts >= at - 20]
    assert sorted((r.query_id, r.memory_id, r.rank) for r in got.collect()) == sorted(want)


MESSAGE = "message_id long, app string, context string, response string, ts double"


def some_messages(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "bravo", "delta", "echo", "foxtrot", "golf", "hotel", "india"]
    talk = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 6)))
    out = [(i, "x", talk(), rng.choice([None, "", talk()]), 5000.0 + i * 300) for i in range(n)]
    out[7] = (7, "x", "my github_pat_hunter2secret", "ok", out[7][4])
    out[9] = (9, "x", "──── ────", None, out[9][4])
    out[11] = (11, "x", None, None, out[11][4])
    return out


def one_by_one(messages):
    """Recalled and recent entries for each message, then it is stored."""
    import re

    def words(t):
        return sorted({w for w in re.findall("[a-z0-9_]+", t.lower()) if len(w) > 1})

    memory, out, fate = [], [], {}
    for i, _, context, response, ts in messages:
        q = hash_embedding(words(context or ""))
        sims = sorted(((-round(float(e @ q / ((np.linalg.norm(e) + 1e-8) * (np.linalg.norm(q) + 1e-8))), 9), j) for j, e, _ in memory))[:3]
        found = [(j, -s) for s, j in sims if -s > 0.4]
        out += [(i, "recalled", k, j, round(s, 6)) for k, (j, s) in enumerate(found, 1)]
        trail = [(j, t) for j, _, t in reversed(memory)][:6]
        out += [(i, "recent", k, j, None) for k, (j, t) in enumerate(trail, 1) if t >= ts - 5400 and j not in {f for f, _ in found}]
        text = (context or "") + (f" ||| {response}" if response else "")
        fate[i] = "credential" if "github_pat_" in text else "junk" if not re.search("[a-z]", text) else "stored"
        if fate[i] == "stored":
            memory.append((i, hash_embedding(words(text)), ts))
    return sorted(out, key=str), fate


@pytest.mark.parametrize("cuts", [(40,), (3, 12, 40)])
def test_capture_loop_is_one_by_one(spark, tmp_path, cuts):
    messages = some_messages(40, 6)
    batches = [messages[a:b] for a, b in zip((0, *cuts), cuts)]
    out = f"{tmp_path}/out"
    got = loop.capture_loop(files(spark, f"{tmp_path}/in", batches, MESSAGE), out)
    want, fate = one_by_one(messages)
    rows = lambda df: sorted(((r.message_id, r.channel, r.rank, r.memory_id, None if r.sim is None else round(r.sim, 6)) for r in df.collect()), key=str)
    assert rows(got) == want
    assert {r.message_id: r.outcome for r in spark.read.parquet(f"{out}/outcomes").collect()} == fate
    stored = spark.read.parquet(f"{out}/stored").count()
    for k, batch in enumerate(batches):  # replayed after the end: nothing changes
        loop.handle(spark.createDataFrame(batch, MESSAGE), k, out)
    again = spark.read.schema(got.schema).parquet(f"{out}/recalled")
    assert rows(again) == want and spark.read.parquet(f"{out}/stored").count() == stored


def test_no_shared_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, name, default=None: default})()

    with pytest.raises(ValueError):
        shared.shared_folder(Session())
