"""Operators on small literal tables."""

import numpy as np
from pyspark.sql import functions as F

from engram.functions import vector as V
from engram.operators import graph, ingest, lexical, lifecycle, metrics, packing, recall
from engram.sources import store


def test_nearest_is_exact_and_blocked(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "memory_id long, embedding array<double>")
    q = df.filter("memory_id < 7").select(F.col("memory_id").alias("query_id"), "embedding")
    got = V.nearest(df, q, 5, block=3).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(7):
        want = np.argsort(-(unit @ unit[i]))[:5]
        assert [r.memory_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want.tolist()
    assert V.nearest(df, q.limit(0), 5).count() == 0


def test_lexical_unknown_tokens_lower_the_ratio(spark):
    e = spark.createDataFrame([(0, "red apple"), (1, "green pear")], "memory_id long, text string")
    q = spark.createDataFrame([(0, "red apple"), (1, "red zebra")], "query_id long, text string")
    got = {(r.query_id, r.memory_id): r.score for r in lexical.scores(e, q).collect()}
    assert abs(got[0, 0] - 1) < 1e-12 and abs(got[1, 0] - 0.5) < 1e-12


def test_fuse_keeps_the_dense_order_on_ties(spark):
    dense = spark.createDataFrame([(0, 1, 0.9, 0), (0, 2, 0.8, 1)], "query_id long, memory_id long, sim double, dense_rank int")
    lex = spark.createDataFrame([(0, 3, 0.5, 0), (0, 2, 0.4, 1)], "query_id long, memory_id long, lex double, lex_rank int")
    got = [r.memory_id for r in recall.fuse(dense, lex).orderBy("fused_rank").collect()]
    assert got == [2, 1, 3]


def test_components_and_lineage(spark):
    n = spark.createDataFrame([(i,) for i in range(8)], "memory_id long")
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (6, 7)], "a long, b long")
    got = {r.memory_id: r.cluster for r in graph.components(n, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 6}
    links = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "memory_id long, superseded_by long")
    assert {(r.memory_id, r.successor, r.depth) for r in graph.ancestry(links).collect()} == {(0, 1, 1), (1, 2, 1), (0, 2, 2)}


def test_supersede_reasons(spark):
    e = spark.createDataFrame([(0, 1, None), (1, None, None), (2, None, None)], "memory_id long, superseded_by long, valid_to double")
    req = spark.createDataFrame([(1, 0), (2, 2), (2, 9), (0, 2)], "old_id long, new_id long")
    after, out = lifecycle.supersede(e, req, 5.0)
    assert {(r.old_id, r.new_id): r.reason for r in out.collect()} == {(1, 0): "cycle", (2, 2): "same", (2, 9): "unknown", (0, 2): "ok"}
    assert {r.memory_id: r.superseded_by for r in after.collect()} == {0: 2, 1: None, 2: None}


def test_ladder():
    toks = lambda t: t.lower().split()
    say = lambda t, **k: {"text": t, "tokens": toks(t), "source": "hook", "ts": 1.0, **k}
    long = "the deploy server lives in the basement rack number seven today"
    out = ingest.ladder([say(long), say(long), say(long + " eight"), say("something else entirely about cats and dogs"), say("phone one", state_key="p"), say("phone two", state_key="p")])
    assert [o["action"] for o in out] == ["new", "strengthened", "merged", "new", "new", "new"]
    assert out[3]["memory_id"] == 2  # the tombstone of the merge took id 1


def test_remember_refuses(spark):
    m = spark.createDataFrame([(0, 0, "token ghp_abc here", "hook", 0.0), (0, 1, "──── ════", "hook", 1.0), (0, 2, "A plain useful fact!", "hook", 2.0)], "scope long, seq long, text string, source string, ts double")
    assert {r.seq: r.action for r in ingest.rolled_up(ingest.remember(m)).collect()} == {0: "rejected", 1: "rejected", 2: "new"}


def test_packing_skips_and_goes_on(spark):
    rows = [(1, 10, "a", "x" * 150), (2, 11, "b", "y" * 90), (3, 12, "c", "z" * 20)]
    df = spark.createDataFrame([(rows,)], "i array<struct<rank:int,memory_id:bigint,label:string,text:string>>")
    p = df.select(packing.packed(F.col("i"), 200).alias("p")).first().p
    assert (p.ids, p.taken, p.skipped) == ([10, 12], 2, 1)


def test_metrics(spark):
    v = spark.createDataFrame([(x,) for x in (0, 0, 1, 5)], "v int")
    assert abs(metrics.gini(v, "v").first().gini - (2 * (1 * 0 + 2 * 0 + 3 * 1 + 4 * 5) / (4 * 6) - 5 / 4)) < 1e-9
    none = spark.createDataFrame([(False, False)], "predicted boolean, gold boolean")
    assert metrics.precision_recall(none).first().precision is None


def test_library_conflict(spark, tmp_path):
    lib = store.Library(spark, f"file://{tmp_path}/lib")
    e = spark.createDataFrame([(0, "hello", 1.0)], "memory_id long, text string, ts double")
    first, fresh = lib.save(e)
    assert fresh and lib.load().first().source == "auto"
    second, fresh = lib.save(lib.load(), base=first)
    assert fresh and lib.current() == second
    other, fresh = lib.save(e, base=first)
    assert not fresh and lib.current() == second and other.startswith("conflict-")
    # Two writers from the same base: the second one finds the pointer placed.
    assert not lib._publish(2, other) and lib.current() == second
    lib._newest = lambda: (1, first)
    late, fresh = lib.save(e, base=first)
    assert not fresh and late.startswith("conflict-") and lib.load(late).count() == 1
    assert store.Library(spark, lib.path).current() == second


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nx: 1\n---\nBody text")
    (tmp_path / "index.md").write_text("skip")
    assert [(r.name, r.text) for r in store.markdown(spark, str(tmp_path)).collect()] == [("a", "Body text")]


def test_capture_stream_is_idempotent(spark, tmp_path):
    from engram.streaming import capture

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    m = spark.createDataFrame([("hello there",), ("ghp_secret",)], "text string")
    m.write.parquet(src)
    for _ in range(2):
        capture.capture(spark.readStream.schema(m.schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    assert [r.text for r in spark.read.parquet(out).select("text").collect()] == ["hello there"]


def test_entry_without_optional_parts():
    import __spark_entry__ as e

    assert e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_rotation_goes_round_at_any_size(spark):
    from engram.operators import lifecycle

    for n in (0, 1, 29, 100, 120, 130, 131, 400):
        live = spark.range(n).selectExpr("id as memory_id", "cast(id as double) as ts")
        newest = list(range(n))[::-1]
        want = {newest[(30 + k) % n] for k in range(min(n, 100))}
        got = [r.memory_id for r in lifecycle.rotation(live, 30, 100).collect()]
        assert set(got) == want and len(got) == len(want)


def test_retirement_falls_back_to_the_last_update(spark):
    from engram.operators import lifecycle

    rows = [(1, 9, 50.0, 900.0, 5.0), (2, 9, None, 900.0, 5.0), (3, 9, 0.0, 40.0, 5.0), (4, 9, None, None, 5.0), (5, None, None, None, 5.0), (6, 9, None, None, None)]
    e = spark.createDataFrame(rows, "memory_id long, superseded_by long, valid_to double, updated_at double, ts double")
    assert {r.memory_id for r in lifecycle.vacuum(e, 100.0, 0.0).collect()} == {2, 5}
    assert {r.memory_id for r in lifecycle.vacuum(e.drop("updated_at"), 100.0, 0.0).collect()} == {5}


def test_novelty_of_first_keyed_and_forced_chunks():
    import numpy as np

    from engram.operators import ingest

    at = {"a": np.array([1.0, 0.0]), "b": np.array([0.6, 0.8])}
    chunk = lambda t, **more: {"text": t * 40, "tokens": [t], "source": "auto", "ts": 1.0, **more}
    out = ingest.ladder([chunk("a"), chunk("b", state_key="k"), chunk("a", force_new=True), chunk("a")], embed=lambda tokens: at[tokens[0]])
    assert [x["action"] for x in out] == ["new", "new", "new", "strengthened"]
    assert np.allclose([x["novelty"] for x in out], [1.0, 2.0, 1.0, 0.0])
