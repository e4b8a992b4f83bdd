"""Discrete codes and their searches against plain numpy, and exact binomial p against integer arithmetic."""

import random
from fractions import Fraction
from math import comb

import numpy as np
from pyspark.sql import functions as F

from engram.operators import codes, metrics


def bits(code, dims):
    planes = len(code) // (-(-dims // 32))
    words = -(-dims // 32)
    out = []
    for p in range(planes):
        text = "".join(format(code[p * words + w], "0%db" % min(32, dims - 32 * w)) for w in range(words))
        out.append(np.array([int(c) for c in text]))
    return out


def plain_ternary(v, k):
    t = np.zeros(len(v), int)
    t[sorted(range(len(v)), key=lambda i: (-v[i], i))[:k]] = 1
    t[sorted(range(len(v)), key=lambda i: (v[i], i))[:k]] = -1
    return t


def rows(n, dims, seed):
    rng = random.Random(seed)
    return [(i, [float(rng.randint(-6, 6)) for _ in range(dims)]) for i in range(n)]


def test_codes(spark):
    for dims in (5, 32, 40, 64):
        data = rows(30, dims, dims)
        df = spark.createDataFrame([*data, (99, None), (98, [])], "memory_id long, embedding array<float>")
        got = {r.memory_id: r for r in df.select("memory_id", codes.strongest(F.col("embedding"), 4).alias("s"), codes.ternary(F.col("embedding"), 3).alias("t")).collect()}
        assert got[99].s is None and got[99].t is None and got[98].s is None
        for i, v in data:
            assert set(np.flatnonzero(bits(got[i].s, dims)[0])) == set(sorted(range(dims), key=lambda j: (-abs(v[j]), j))[:4])
            either, plus = bits(got[i].t, dims)
            assert (np.where(plus == 1, 1, np.where(either == 1, -1, 0)) == plain_ternary(v, 3)).all()


def test_searches(spark):
    data = rows(80, 64, 1)
    df = spark.createDataFrame([*data, (500, None)], "memory_id long, embedding array<float>")
    t = {i: plain_ternary(v, 16) for i, v in data}
    s = {i: set(sorted(range(64), key=lambda j: (-abs(v[j]), j))[:11]) for i, v in data}
    for kind, code, score in (("ternary", codes.ternary(F.col("embedding"), 16), lambda a, b: int(t[a] @ t[b])), ("overlap", codes.strongest(F.col("embedding"), 11), lambda a, b: len(s[a] & s[b]))):
        coded = df.select("memory_id", code.alias("code"))
        got = codes.nearest_by(coded, coded.filter("memory_id < 12").withColumnRenamed("memory_id", "query_id"), 7, kind, block=5).collect()
        want = [(q, i, score(q, i), k) for q in range(12) for k, i in enumerate(sorted(t, key=lambda i: (-score(q, i), i))[:7])]
        assert sorted((r.query_id, r.memory_id, r.score, r.rank) for r in got) == sorted(want)


def test_agreement(spark):
    make = lambda x: spark.createDataFrame([(q, i, k) for q, ids in x.items() for k, i in enumerate(ids)], "query_id long, memory_id long, rank int")
    r = codes.agreement(make({1: [5, 6, 7], 2: [9, 8, 1]}), make({1: [5, 7, 2], 2: [8, 9, 3], 3: [1, 2, 3]}), 3).first()
    assert (r.queries, round(r.recall, 9), round(r.first, 9)) == (3, round((2 / 3 + 2 / 3 + 0) / 3, 9), round(1 / 3, 9))


def test_exact_p(spark):
    pairs = [(0, 0), (1, 0), (0, 5), (3, 3), (8, 2), (40, 60), (100, 100), (500, 430), (5000, 5000), (4900, 5100), (4700, 5300), (9000, 1000), (1, 9999)]
    got = {(r.b, r.c): r.p for r in spark.createDataFrame(pairs, "b long, c long").withColumn("p", metrics.binomial_p(F.col("b"), F.col("c"))).collect()}
    for b, c in pairs:
        tail = Fraction(2 * sum(comb(b + c, i) for i in range(min(b, c) + 1)), 2 ** (b + c))
        want = float(min(Fraction(1), tail))
        assert abs(got[b, c] - want) <= 1e-9 and (want == 0 or want < 1e-290 or abs(got[b, c] / want - 1) < 1e-8)
    assert spark.createDataFrame([(None, 3)], "b long, c long").select(metrics.binomial_p(F.col("b"), F.col("c")).alias("p")).first().p is None


def test_paired(spark):
    data = [(True, True)] * 4 + [(True, False)] * 7 + [(False, True)] * 2 + [(False, False)] * 3
    r = metrics.paired(spark.createDataFrame(data, "a boolean, b boolean"), "a", "b").first()
    assert (r.both_true, r.only_a, r.only_b, r.none_true) == (4, 7, 2, 3)
    assert abs(r.p - 2 * sum(comb(9, i) for i in range(3)) / 2**9) < 1e-12
