"""Searches and similarity joins against plain sums, and what they hold at once or hand on."""

import numpy as np
import pytest

from engram.functions import vector as V
from engram.operators import graph, tree


@pytest.fixture(scope="module")
def rows():
    x = np.random.default_rng(3).standard_normal((600, 8)).round(3)
    x[40:60] = x[7]
    return [(i, [float(c) for c in v], i % 3 or None) for i, v in enumerate(x)]


def cosines(rows):
    x = np.array([r[1] for r in rows])
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    return x @ x.T


def frame(spark, rows):
    return spark.createDataFrame(rows, "memory_id long, embedding array<float>, label long")


def test_best_by_hands_on_no_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 64)
    monkeypatch.setattr(V, "STEP", 7)
    v = frame(spark, rows)
    got = V.best_by(v, v.filter("memory_id % 5 = 0"), "label", block=50)
    assert "query_id" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for a query and an item
    sims, want = cosines(rows), {}
    for i, *_ in rows:
        for q, _, g in rows[::5]:
            want[i, g] = max(want.get((i, g), -2.0), sims[i, q])
    found = {(r.memory_id, r.label): r.sim for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-6 for x in want)


def test_nearest_compares_small_matrices(spark, rows, monkeypatch):
    """One partition of 600 rows in one batch: no more than ``ROWS`` times ``STEP`` cells are compared at once."""
    monkeypatch.setattr(V, "ROWS", 32)
    monkeypatch.setattr(V, "STEP", 16)
    plain = V._unlike

    def small(x, q):
        assert len(x) <= 32 and len(q) <= 16
        return plain(x, q)

    monkeypatch.setattr(V, "_unlike", small)
    v = frame(spark, rows).coalesce(1)
    q = v.filter("memory_id % 5 = 0").withColumnRenamed("memory_id", "query_id")
    sims = cosines(rows)
    for k in (1, 7, 50):
        got = V.nearest(v, q, k).collect()
        assert len(got) == k * 120
        for r in got:
            assert abs(r.sim - sims[r.query_id, r.memory_id]) < 1e-6
        for i in range(0, 600, 5):
            mine = sorted(r.sim for r in got if r.query_id == i)
            assert np.allclose(mine, np.sort(sims[i])[-k:], atol=1e-6)


def test_nearest_hands_on_from_few_tasks(spark, rows):
    v = frame(spark, rows).repartition(64)
    q = v.filter("memory_id % 5 = 0").withColumnRenamed("memory_id", "query_id")
    assert "Coalesce" in V.nearest(v, q, 3)._jdf.queryExecution().executedPlan().toString()


def components(edges, ids):
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("theta", [0.7, 0.93])
def test_similar_pairs_in_strips(spark, rows, monkeypatch, theta):
    monkeypatch.setattr(graph, "STRIP", 5)
    sims = cosines(rows)
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if sims[i, j] >= theta}
    got = graph.similar_pairs(frame(spark, rows), theta, pivots=9, block=40).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


@pytest.mark.parametrize("theta", [0.7, 0.93])
def test_clusters_hand_on_no_pairs(spark, rows, theta):
    """In one cell, two slices hand on less than a row for each of their rows, however many pairs they hold; the components stay."""
    v, sims = frame(spark, rows), cosines(rows)
    want = components([(i, j) for i in range(600) for j in range(i + 1, 600) if sims[i, j] >= theta], range(600))
    assert graph.similar_pairs(v, theta, pivots=1, forest=True).count() < 600
    for pivots, block in ((1, 2048), (9, 40)):
        forest = graph.similar_pairs(v, theta, pivots=pivots, block=block, forest=True).collect()
        assert components([(r.a, r.b) for r in forest], range(600)) == want
    assert {r.memory_id: r.cluster for r in graph.clusters(v, theta).collect()} == want


def test_stars_of_a_chain():
    near = np.eye(50, dtype=bool) | np.eye(50, k=1, dtype=bool)
    near[:, 30] = near[30] = False
    a, b = graph._stars(near, np.arange(100, 150), np.arange(200, 250))
    found = components(zip(a.tolist(), b.tolist()), [*range(100, 150), *range(200, 250)])
    assert {found[i] for i in range(100, 130)} == {100} and {found[i] for i in range(131, 150)} == {131} and found[130] == 130 and found[230] == 230


def test_rows_visit_few_at_a_time(spark, rows, monkeypatch):
    """A row may visit every cell, so a whole batch with its copies is never held."""
    monkeypatch.setattr(graph, "STRIP", 5)
    plain = graph._unit

    def small(x):
        assert len(x) <= 20
        return plain(x)

    monkeypatch.setattr(graph, "_unit", small)
    assert graph.similar_pairs(frame(spark, rows).coalesce(1), 0.93, pivots=9).count()


@pytest.mark.parametrize("sizes", [(4096, 500_000, 1024, 256, 4096), (7, 60, 30, 3, 4)])
def test_tree_best_hands_on_k_rows(spark, rows, monkeypatch, sizes):
    """The collector against plain counts; no row is made for a query and a member."""
    for name, n in zip(("SHARED", "WORDS", "ROWS", "STEP", "WIDE"), sizes, strict=True):
        monkeypatch.setattr(tree, name, n)
    sims = np.round(cosines(rows), 6)
    words = {i: None if i % 41 == 5 else [f"w{j}" for j in range(12) if (i * 7 + j * j) % 5 < 2 and j % (i % 4 + 1) == 0] for i, *_ in rows}
    members = spark.createDataFrame([(i, i % 3, i % 4, v, words[i]) for i, v, _ in rows], "memory_id long, l1 long, l2 long, embedding array<float>, words array<string>")
    q = members.filter("memory_id % 20 = 5").select(members.memory_id.alias("query_id"), "embedding", "words")
    found = spark.createDataFrame([(i, a, (i // 20 + a) % 4) for i in range(5, 600, 20) for a in (0, 2)], "query_id long, l1 long, l2 long")
    out = tree.best(members, found, q, 6)
    assert "l1" not in out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.shared, r.memory_id, r.sim))
    for i in range(5, 600, 20):
        inside = [m for m, *_ in rows if m % 3 in (0, 2) and m % 4 == (i // 20 + m % 3) % 4]
        shared = {m: None if words[i] is None or words[m] is None else len(set(words[i]) & set(words[m])) for m in inside}
        key = lambda m: (-(shared[m] if shared[m] is not None else -1), -sims[i, m])
        want = sorted(inside, key=lambda m: (*key(m), m))[:6]
        assert [x[0] for x in sorted(got[i], key=lambda x: -1 if x[0] is None else x[0], reverse=True)] == [shared[m] for m in want]
        assert np.allclose(sorted(x[2] for x in got[i]), sorted(sims[i, m] for m in want), atol=1e-5)


def test_best_match_compares_few_patterns(spark, monkeypatch):
    from engram.operators import hopfield

    monkeypatch.setattr(hopfield, "ROWS", 10)
    x = np.where(np.random.default_rng(5).standard_normal((300, 6)) > 0, 1, -1)
    p = spark.createDataFrame([(299 - i, [int(c) for c in r]) for i, r in enumerate(x)], "memory_id long, code array<int>").coalesce(1)
    got = hopfield.best_match(p, p.filter("memory_id % 9 = 0").withColumnRenamed("memory_id", "query_id")).collect()
    for r in got:
        equal = [299 - i for i in range(300) if (x[i] == x[299 - r.query_id]).all()]
        assert (r.memory_id, r.overlap) == (min(equal), 1.0)


def test_redaction_looks_first(spark):
    """Texts without a credential skip the chain of replacements; results stay."""
    from pyspark.sql import functions as F

    from engram.functions import text as T

    texts = [None, "", "plain words", "a key sk-ant-abc and ghp_x", "rc-" + "0a" * 20, "x" * 45 + " is my token", "x" * 45 + " is long"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", T.redacted(F.col("text")).alias("r"))
    assert "CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: (r.r.text, r.r.hits) for r in df.collect()}
    assert [got[i] for i in range(7)] == [(None, None), ("", 0), ("plain words", 0), ("a key [REDACTED]abc and [REDACTED]x", 2), ("[REDACTED]", 1), ("[REDACTED] is my token", 1), (texts[6], 0)]


def test_codes_as_bits(spark):
    from pyspark.sql import functions as F

    from engram.functions import lenient
    from engram.operators.ingest import hash_embedding

    lists = [["alpha", "beta"], [], ["beta"], [f"w{i}" for i in range(90)]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i long, w array<string>").select("i", lenient.embed_bits(F.col("w")).alias("b"))
    for r in df.collect():
        assert np.array_equal(np.unpackbits(np.frombuffer(bytes(r.b), np.uint8)), hash_embedding(lists[r.i]) > 0)


def test_unique_codes_makes_codes_once(spark):
    from engram import registry

    plan = registry.QUERIES["J15_unique_codes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan  # the join reads codes that are there
