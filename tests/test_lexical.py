"""Lexical scores in the tasks against plain sums, for all pairs and for the best k, in blocks of any size."""

import math
import random
from collections import Counter, defaultdict

import pytest

from engram.operators import lexical


def plain(entries, queries, mode):
    held = {i: set((t or "").lower().split()) for i, t in entries}
    df = Counter(w for s in held.values() for w in s)
    idf = lambda w: math.log(1 + len(entries) / df.get(w, 1))
    asked = defaultdict(list)
    for q, t in queries:
        asked[q] += sorted(set((t or "").lower().split()))
    out = {}
    for q, words in asked.items():
        whole = 1.0 if mode == "sum" else sum(idf(w) for w in words if w in df or mode == "ratio")
        for i, have in held.items():
            found = [idf(w) for w in words if w in have]
            if found:
                out[q, i] = sum(found) / whole if mode == "sum" else min(sum(found) / whole, 1.0)
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    say = lambda n, extra=(): " ".join(rng.choice([*words[:5], *words, *extra]) for _ in range(n))
    entries = [(i, say(rng.randint(0, 25))) for i in range(300)] + [(300, None), (301, "")]
    entries += [(400 + i, entries[7][1]) for i in range(20)]
    queries = [(q, say(rng.randint(1, 9), ["unknown", "nowhere"])) for q in range(40)] + [(3, "w1 w2 w3"), (90, None), (91, "unknown")]
    return entries, queries


@pytest.mark.parametrize("mode", ["ratio", "sum", "known"])
@pytest.mark.parametrize("sizes", [(500_000, 2048, 4096), (30, 4, 32)])
def test_scores(spark, data, monkeypatch, mode, sizes):
    for name, n in zip(("WORDS", "QUERIES", "ROWS"), sizes, strict=True):
        monkeypatch.setattr(lexical, name, n)
    entries, queries = data
    e, q = spark.createDataFrame(entries, "memory_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")
    want = plain(entries, queries, mode)
    got = {(r.query_id, r.memory_id): r.score for r in lexical.scores(e, q, mode).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    best = defaultdict(list)
    for (a, b), s in want.items():
        best[a].append((-round(s, 9), b))
    top = lexical.scores(e, q, mode, 7).collect()
    assert sorted((r.query_id, r.rank, r.memory_id) for r in top) == sorted((a, k, b) for a, x in best.items() for k, (_, b) in enumerate(sorted(x)[:7]))


def test_matches_without_pairs(spark, data):
    entries, queries = data
    e, q = spark.createDataFrame(entries, "memory_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    held = [set((t or "").lower().split()) for _, t in entries]
    want = Counter()
    for i, t in queries:
        want[i] += sum(len(set((t or "").lower().split()) & have) for have in held)
    found = lexical.matches(e, q)
    assert {r.query_id: r.matches for r in found.collect()} == {i: n for i, n in want.items() if n}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate [token")  # below the join: frequencies, not postings


@pytest.mark.parametrize("mode", ["ratio", "sum", "known"])
def test_pair_scores(spark, data, mode):
    entries, queries = data
    e, q = spark.createDataFrame(entries, "memory_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    want = plain(entries, queries, mode)
    asked = [(a, b) for a in (0, 3, 7, 90, 91) for b in (*range(0, 300, 7), 300, 301, 405)]
    found = lexical.pair_scores(e, q, spark.createDataFrame(asked + asked[:9], "query_id long, memory_id long"), mode)
    got = {(r.query_id, r.memory_id): r.score for r in found.collect()}
    assert got.keys() == {(a, b) for a, b in asked if a in {x for x, _ in want}} and all(abs(got[x] - want.get(x, 0.0)) < 1e-9 for x in got)


def test_ranked_in_small_parts(spark, data, monkeypatch):
    monkeypatch.setattr(lexical, "RANKED", 3)
    entries, queries = data
    e, q = spark.createDataFrame(entries, "memory_id long, text string").repartition(40), spark.createDataFrame(queries, "query_id long, text string")
    best = defaultdict(list)
    for (a, b), s in plain(entries, queries, "ratio").items():
        best[a].append((-round(s, 9), b))
    top = lexical.scores(e, q, "ratio", 7)
    assert "Coalesce" in top._jdf.queryExecution().executedPlan().toString()  # k rows per query from few tasks
    assert sorted((r.query_id, r.rank, r.memory_id) for r in top.collect()) == sorted((a, k, b) for a, x in best.items() for k, (_, b) in enumerate(sorted(x)[:7]))


def test_effective_takes_scores_of_its_pairs_only(spark, monkeypatch):
    """All pairs of queries and entries that share a word never move."""
    from engram import registry

    whole = lexical.scores
    monkeypatch.setattr(lexical, "scores", lambda e, q, mode="ratio", k=None: whole(e, q, mode, k) if k else pytest.fail("all pairs"))
    assert registry.QUERIES["L21_effective"](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("mode", ["ratio", "sum", "known"])
def test_all_pairs_come_by_score(spark, data, monkeypatch, mode):
    """Equal numbers lie side by side in a block's pairs, none is lost between the parts that are handed on, and no part is large."""
    monkeypatch.setattr(lexical, "PAIRS", 700)
    entries, queries = data
    e, q = spark.createDataFrame(entries, "memory_id long, text string").coalesce(1), spark.createDataFrame(queries, "query_id long, text string")
    got = [(r.query_id, r.memory_id, r.score) for r in lexical.scores(e, q, mode).collect()]
    want = plain(entries, queries, mode)
    assert len(got) == len(want) > 2000 and {x[:2] for x in got} == want.keys() and all(abs(s - want[a, b]) < 1e-9 for a, b, s in got)
    assert [round(s, 6) for *_, s in got] == sorted(round(s, 6) for *_, s in got)


def test_weights_are_added_in_blocks_not_word_by_word():
    """Common words through matrix products, rare ones through lists of cells: the sums of adding word by word, in much less time."""
    import time

    import numpy as np

    rng = np.random.default_rng(6)
    queries, rows, words = 256, 1024, 30_000
    often = np.where(np.arange(words) < 100, 0.6, 0.003)
    asked = [np.flatnonzero(rng.random(queries) < 4 * p) for p in often]
    having = [np.flatnonzero(rng.random(rows) < p) for p in often]
    query, entry = np.concatenate(asked), np.concatenate(having)
    ends, bounds = np.cumsum([0, *map(len, asked)]), np.cumsum([0, *map(len, having)])
    weight = rng.random(len(query))
    want, got = np.zeros((queries, rows)), np.zeros((queries, rows))
    t = time.perf_counter()
    for w in range(words):
        want[np.ix_(asked[w], having[w])] += weight[ends[w] : ends[w + 1], None]
    slow, t = time.perf_counter() - t, time.perf_counter()
    lexical.added(got, ends[:-1], ends[1:], query, weight, bounds, entry)
    assert time.perf_counter() - t < slow / 1.5
    assert np.allclose(got, want, rtol=1e-12, atol=0) and ((got > 0) == (want > 0)).all()
    none = np.zeros(0, np.int64)
    lexical.added(got, none, none, query, weight, np.zeros(1, np.int64), none)


def test_rounded_is_sparks_round(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.random(2000), rng.random(500) * 300, (rng.integers(0, 10**7, 2000) * 10 + 5) / 1e7, np.nextafter((rng.integers(0, 10**6, 500) * 10 + 5) / 1e7, 9), [0.0, 1.0, 0.9999995, 2.5e-6, 5e-7]])
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").select("i", F.round("x", 6).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == lexical.rounded(x, 6).tolist()
