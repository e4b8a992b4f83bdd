"""Operators without an oracle, against plain Python on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import vector as V
from engram.operators import cases, hopfield, ingest, recall, tree


@pytest.fixture(scope="module")
def rows():
    x = np.random.default_rng(3).standard_normal((60, 16)).astype(np.float32)
    x[7] = x[3]
    return x


@pytest.fixture(scope="module")
def vecs(spark, rows):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(60, None)], "memory_id long, embedding array<float>").repartition(5)


def test_nearest_over_several_blocks_and_batches(spark, vecs, rows):
    q = vecs.filter("memory_id % 5 = 0").select(F.col("memory_id").alias("query_id"), "embedding")
    n = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    sims = n @ n.T
    got = {(r.query_id, r["rank"]): r.memory_id for r in V.nearest(vecs, q, 4, block=3).collect()}
    assert len(got) == 12 * 4
    for i in range(0, 60, 5):
        want = np.lexsort((np.arange(60), -np.round(sims[i], 6)))[:4]
        assert {got[i, r] for r in range(4)} == set(want.tolist())
    every = V.nearest(vecs, q, None, block=5)
    assert every.count() == 12 * 60
    assert V.nearest(vecs, q.limit(0), 4).count() == 0
    assert V.nearest(vecs.limit(0), q, 4).count() == 0


def test_codes_and_their_union(spark, vecs, rows):
    planes = np.random.default_rng(42).standard_normal((256, 16)) / 4
    p = rows.astype(float) @ planes.T
    want = p >= np.sort(p, axis=1)[:, -64, None]
    coded = vecs.select("memory_id", V.projected_code("embedding", 16, bits=256, keep=0.25).alias("code"))
    bits = lambda c: np.unpackbits(np.array(c, np.int64).view(np.uint8), bitorder="little").astype(bool)
    got = {r.memory_id: r.code for r in coded.collect()}
    assert got.pop(60) is None
    assert all((bits(c) == want[i]).all() for i, c in got.items())
    u = V.united(coded.filter("code is not null").withColumn("g", F.col("memory_id") % 4), "g").collect()
    assert all((bits(r.code) == want[r.g :: 4].any(axis=0)).all() for r in u)
    near = V.nearest_codes(coded, coded.filter("memory_id in (3, 10)").withColumnRenamed("memory_id", "query_id"), 5, block=1).collect()
    for q in (3, 10):
        ham = (want ^ want[q]).sum(axis=1)
        order = np.lexsort((np.arange(60), ham))[:5]
        assert [(r.memory_id, r.ham) for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == q] == [(i, ham[i]) for i in order]


def test_pattern_completion_by_compartment(spark, vecs, rows):
    s = np.where(rows > 0, 1, -1)
    p = vecs.filter("embedding is not null").select("memory_id", hopfield.signs(F.col("embedding")).alias("code"), (F.col("memory_id") % 3).alias("compartment"))
    cues = p.filter("memory_id in (4, 5)").select(F.col("memory_id").alias("query_id"), "code")
    got = {(r.query_id, r.compartment): (r.memory_id, r.overlap) for r in hopfield.recall_all(p, cues, 3, rounds=2).collect()}
    for q in (4, 5):
        for c in range(3):
            mine, state = s[c::3], s[q]
            for _ in range(2):
                state = np.where(mine.T @ (mine @ state) >= 0, 1, -1)
            m = mine @ state / 16
            assert got[q, c] == (3 * int(m.argmax()) + c, m.max())


def test_novelty_gates(spark):
    said = ["alpha beta gamma", "alpha beta gamma", None, "delta epsilon zeta", "beta gamma alpha"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "scope long, seq long, text string")
    got = [r.stored for r in ingest.novelty_gate(df).orderBy("seq").collect()]
    assert got == [True, False, True, True, False]
    coded = ingest.novelty_gate(df, 0.01, codes=True).orderBy("seq").collect()
    assert [r.stored for r in coded] == [True, False, True, True, False]
    assert ingest.novelty_gate(df.limit(0)).count() == 0


def test_cases(spark):
    schema = "case_id long, memories array<struct<id:bigint,text:string>>, remember array<string>, supersede array<struct<old_id:bigint,remember_index:int>>, consolidate array<struct<memory_ids:array<bigint>,conclusion:string>>, forget array<struct<memory_id:bigint>>"
    secret = "the key is github_pat_" + "A1b2C3d4E5" * 4
    full = (1, [(1, "a"), (2, "b"), (3, "c")], ["A fact worth keeping here.", secret, None], [(1, 0), (1, 1), (9, 0), (2, 7), (2, None)], [([2, 1, 2, 9], "Both of them hold together."), ([1], "Alone it says little."), ([1, 2], secret)], [(3,), (3,), (8,)])
    got = {r.case_id: r for r in cases.execute(spark.createDataFrame([full, (2, None, None, None, None, None)], schema)).collect()}
    r = got[1]
    assert r.remembered == [True, False, False]
    assert [x.reason for x in r.superseded] == ["ok", "bad_index", "unknown", "bad_index", "bad_index"]
    assert [(x.ids, x.reason) for x in r.consolidated] == [([1, 2], "ok"), ([1], "too_few"), ([1, 2], "refused")]
    assert [x.reason for x in r.forgotten] == ["ok", "unknown", "unknown"]
    assert (r.n_ok, r.n_errors) == (4, 10)
    assert (got[2].n_ok, got[2].n_errors) == (0, 0)


def test_corrections_number_in_order(spark):
    df = spark.createDataFrame([(i, f"A corrected fact number {i} here") for i in range(40)] + [(99, None)], "old_id long, text string").repartition(7)
    got = sorted(map(tuple, cases.corrections(df, 1000)[1].collect()))
    assert got == [(i, 1000 + i) for i in range(40)]


def test_tree_and_months(spark, vecs):
    m = vecs.filter("embedding is not null").withColumn("l1", F.col("memory_id") % 3).withColumn("l2", F.col("memory_id") % 2)
    q = m.filter("memory_id < 4").select(F.col("memory_id").alias("query_id"), "embedding")
    every = tree.navigate(m, q, 3, 2)
    assert every.count() == 4 * 60  # all clusters visited: everything is collected
    best = tree.collected(every, q, 1).collect()
    assert {r.query_id: r.memory_id for r in best} == {i: i for i in range(4)}
    assert recall.months("2023-11", "2023-12") == (1698796800.0, 1701388800.0 + 31 * 86400)


def test_similar_pairs_meet_cell_by_cell(spark, vecs, rows):
    from engram.operators import graph

    more = spark.createDataFrame([(70 + i, rows[3].tolist()) for i in range(20)] + [(95, [0.0] * 16), (96, [0.0] * 16)], vecs.schema)
    v = vecs.unionByName(more)
    x = {r.memory_id: np.array(r.embedding, float) for r in v.collect() if r.embedding is not None}
    ids = sorted(x)
    cos = lambda a, b: x[a] @ x[b] / ((np.linalg.norm(x[a]) + 1e-8) * (np.linalg.norm(x[b]) + 1e-8))
    for theta in (0.3, 0.9):
        want = {(a, b) for a in ids for b in ids if a < b and cos(a, b) >= theta}
        got = [(r.a, r.b) for r in graph.similar_pairs(v, theta, pivots=6, block=4).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    parent = {i: i for i in ids}
    for a, b in sorted((a, b) for a in ids for b in ids if a < b and cos(a, b) >= 0.5):
        ra, rb = parent[a], parent[b]
        parent = {i: min(ra, rb) if p in (ra, rb) else p for i, p in parent.items()}
    got = {r.memory_id: r.cluster for r in graph.clusters(v, 0.5).collect()}
    assert got == parent | {60: 60}
    assert graph.similar_pairs(v.limit(0), 0.5).count() == 0
    assert graph.clusters(v.limit(0), 0.5).count() == 0


def test_similar_pairs_of_other_texts_need_no_common_opening(spark, tmp_path, rows):
    from engram.registry import QUERIES

    texts = {0: "one opening, and on", 1: "another opening", 2: "one opening, and on", 3: None, 4: "far away"}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, (rows[0] if i < 4 else -rows[0]).tolist(), 0) for i in texts], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r.a, r.b, r.sim) for r in QUERIES["D10_similar_other_text"](spark, str(tmp_path)).collect()) == [(0, 1, 1.0), (1, 2, 1.0)]
