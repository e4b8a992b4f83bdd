"""Suffix dedup, Merkle manifest and whitening against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.llm import embedding_whitening, merkle_manifest, suffix_dedup
from engram.llm.common import SPENT, _bytes_of

# Suffix dedup


def plain_removed(texts, span=100):
    """For texts in order, each as bytes: maximal removed runs."""
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - span + 1):
            w = t[p : p + span]
            if w in seen:
                gone[p : p + span] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(k) for k in (12, 25, 40, 90)]
    line = prose(10)[:70]
    out = ["", None, "a" * 99, "a" * 100, "a" * 350, "ab" * 200, line * 12, prose(300)]
    out += [out[-1]] * 5
    for _ in range(40):
        out.append(prose(rng.randint(5, 40)) + rng.choice(shared) + prose(rng.randint(0, 30)) + line + rng.choice(shared)[7:])
    t = prose(400)
    out += [t[:k] + "X" + t[k:] for k in range(0, 1500, 150)]
    return out


@pytest.mark.parametrize("bucket", [64_000, 40])
def test_suffix_dedup_brute_force(spark, bucket):
    texts = corpus(3)
    ids = list(range(0, 3 * len(texts), 3))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("lead", F.lit(1)).repartition(5)
    want = plain_removed([(t or "").encode() for t in texts])
    assert sum(map(len, want)) > 60
    got = {r.doc_id: r for r in suffix_dedup.removed(docs, bucket=bucket).collect()}
    assert sorted(got) == ids
    for i, t, runs in zip(ids, texts, want, strict=True):
        t = (t or "").encode()
        assert [(s.start, s.stop) for s in got[i].spans] == runs
        assert got[i].n_bytes == len(t)
        at, kept = 0, b""
        for a, b in runs:
            kept, at = kept + t[at:a], b
        assert bytes(got[i].kept) == kept + t[at:]


@pytest.mark.parametrize("span,core", [(20, 8), (33, 12), (64, 40)])
def test_suffix_dedup_other_spans(spark, span, core):
    texts = [t for t in corpus(5) if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in suffix_dedup.removed(docs, span=span, core=core, bucket=200).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removed([t.encode() for t in texts], span)


def test_suffix_dedup_null_and_reused_ids(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, long), (None, long), (1, long), (1, long + " tail"), (2, None), (2, "")]
    got = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((a is None, a or 0) for a, _ in rows)
    n = len(long.encode())
    left = sorted(bytes(r.kept).decode() for r in got)
    first = [r for r in got if r.doc_id is None and not r.spans]
    assert len(first) == 1 and bytes(first[0].kept).decode() == long
    assert left.count(long) == 1 and all(len(r.spans) <= 1 for r in got) and sum(s.stop - s.start for r in got for s in r.spans) >= 3 * n - 1


def test_suffix_dedup_no_rows(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_text_ids(spark):
    long = " ".join(f"word{i}" for i in range(60))
    got = {r.doc_id: len(r.spans) for r in suffix_dedup.removed(spark.createDataFrame([("b", long), ("a", long)], "doc_id string, text string")).collect()}
    assert got == {"a": 0, "b": 1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=90), max_size=6))
def test_equal_strings_have_equal_anchors(texts):
    span, core = 24, 8
    data, at = _bytes_of(pa.array([t.encode() for t in texts], pa.binary()))
    first, n, anchor, h = suffix_dedup.anchors(data, at, span, core)
    raw, where = data.tobytes(), {}
    starts = []
    for a, m, x, k in zip(first.tolist(), n.tolist(), anchor.tolist(), h.tolist(), strict=True):
        for p in range(a, a + m):
            starts.append(p)
            assert p <= x <= p + span - core
            assert where.setdefault(raw[p : p + span], (x - p, k)) == (x - p, k)
    assert starts == [int(a) + p for a, t in zip(at.tolist(), texts) for p in range(len(t.encode()) - span + 1)]


def test_anchors_in_steps_of_a_long_text():
    rng = np.random.default_rng(0)
    data = np.frombuffer(bytes(rng.integers(97, 101, 150_000).astype(np.uint8)) + b"-" * 1000, np.uint8)
    first, n, anchor, _ = suffix_dedup.anchors(data, np.array([0, len(data)]))
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == len(data) - 99
    assert (anchor >= first + n - 1).all() and (anchor <= first + 60).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=8, max_size=20).map(lambda b: bytes(x % 2 for x in b))), max_size=30))
def test_multikey_quicksort_finds_equals(rows):
    data, at = _bytes_of(pa.array([b for _, b in rows], pa.binary()))
    size = np.diff(at)
    group = np.array([g for g, _ in rows], np.int64) * 100 + size
    index, part = suffix_dedup.equal_runs(suffix_dedup._unaligned(data, ">u8"), at[:-1], size, group)
    sets = defaultdict(set)
    for i, p in zip(index.tolist(), part.tolist(), strict=True):
        sets[p].add(i)
    want = defaultdict(set)
    for i, row in enumerate(rows):
        want[row].add(i)
    assert sorted(map(sorted, sets.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout=3):
    """Root and, for each node, the (left, right) siblings at each level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for p, path in enumerate(paths):
            run, k = runs[places[p] // fanout], places[p] % fanout
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
            places[p] //= fanout
        nodes = [sha(*run) for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    leaf = lambda r: sha(*map(enc, r))
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], []
    for s in order:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in mine])
        subs.append(root)
        inner.append((mine, paths))
    root, top = climb(subs)
    out = []
    for (mine, paths), sub, above in zip(inner, subs, top, strict=True):
        for r, path in zip(mine, paths, strict=True):
            whole = path + above
            even = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
            told = sha(*map(enc, (*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])))
            for a, b in whole:
                told = sha(a, told, b)
            out.append((r[0], leaf(r), sub, root, sha(*(a + b for a, b in whole)), told, told == root))
    return sorted(out, key=str)


def documents(n, sources):
    rng = random.Random(n)
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None, 70]), rng.choice([None, "", "a\nb", "né\n", "plain", "\n" * 5])) for i in range(n)]
    return rows + [rows[0], rows[0], (None, sources[0], "x", 1, "null id\n"), (0, sources[0], "other", 1, "same id")] if n > 3 else rows


@pytest.mark.parametrize("n,sources", [(1, ["s"]), (2, ["s"]), (3, [None]), (40, ["b", "B", None, "é", "z", "", "aa"]), (200, ["hot"] * 9 + ["x", "y", None])])
def test_manifest_brute_force(spark, tmp_path, n, sources):
    rows = documents(n, sources)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumn("grp", F.lit(1)).withColumn("leaf", F.lit("q")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle_manifest.query(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


def test_manifest_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle_manifest.query(spark, str(tmp_path)).collect() == []


def test_manifest_other_fanout_and_fields(spark):
    rows = [(f"k{i:03}", "g", str(i)) for i in range(37)]
    df = spark.createDataFrame(rows, "id string, part string, body string")
    got = merkle_manifest.manifest(df, fields=["id", "body"], id_col="id", group_col="part", fanout=5)
    got = got.withColumn("again", merkle_manifest.folded(F.col("path"), F.col("leaf"))).collect()
    root, paths = climb([sha(enc(a), enc(c)) for a, _, c in rows], 5)
    assert {r.id: [tuple(s) for s in r.path] for r in got} == {a: p for (a, _, _), p in zip(rows, paths, strict=True)}
    assert {r.root for r in got} == {r.again for r in got} == {root}


# Whitening


def plain_whitening(rows, components=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in good]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums).astype(np.float64) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    out = {}
    for (i, _), v in zip(good, x, strict=True):
        away = [int(n * a - s) for a, s in zip(v, sums, strict=True)]
        w = (np.array(away, np.float64) / n) @ axes[:, :k] / np.sqrt(values[:k])
        out[i] = (n, sum(a * a for a in away), w, values[:k] / values.sum())
    return out


def vectors(count, dims, seed=0, rank=None):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, rank or dims)) @ rng.normal(size=(rank or dims, dims))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("dims", [1, 5, 24])
def test_whitening_brute_force(spark, dims):
    rows = vectors(120, dims, dims)
    bad = [(900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] + [0.0] * (dims - 1)), (905, [1.0] * (dims + 1))]
    copies = [(1000 + i, rows[3][1]) for i in range(60)]
    df = spark.createDataFrame(rows + bad + copies, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(0)).repartition(4)
    want = plain_whitening(rows + copies)
    got = defaultdict(list)
    for r in embedding_whitening.whitened(df).collect():
        got[r.vec_id].append(r)
    assert sorted(got) == sorted(want)
    signs = np.sign(np.array([r.whitened for r in sorted(got[0], key=lambda r: r.component)]) * want[0][2])
    for i, (n, deviation, w, share) in want.items():
        mine = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, len(w) + 1))
        assert {(r.n, r.deviation) for r in mine} == {(n, deviation)}
        np.testing.assert_allclose([r.whitened for r in mine], w * signs, rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose([r.explained for r in mine], share, rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in mine)


def test_whitening_ends_at_the_rank(spark):
    rows = [(i, [float(a), float(2 * a), 7.0, float(b)]) for i, (a, b) in enumerate((a, b) for a in range(5) for b in range(4))]
    got = embedding_whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 40 and max(r.identity_error for r in got) < 1e-9
    assert abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-9


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])]):
        got = embedding_whitening.whitened(make(rows))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = embedding_whitening.whitened(make([(None, [0.0, 1.0]), (None, [2.0, 1.0])])).collect()
    assert [(r.vec_id, r.n, r.deviation) for r in got] == [(None, 2, 128**2)] * 2


def test_whitening_of_huge_entries(spark):
    got = embedding_whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got if r.vec_id == 1} == {None} and all(np.isfinite(r.whitened) for r in got)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=8))
def test_deviations_are_exact(rows):
    n, sums = len(rows), [sum(c) for c in zip(*rows, strict=True)]
    want = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in rows]
    assert embedding_whitening.deviations(np.array(rows, np.int64), n, sums) == [w if w < 2**63 else None for w in want]


def test_equal_stretches_of_a_batch_travel_once(spark):
    """Of equal stretches in a batch of documents only the first carries its bytes; the leading string isn't carried beside them."""
    text = " ".join(str(x) for x in np.random.default_rng(4).integers(0, 10**6, 60))
    docs = spark.createDataFrame([(i, text) for i in range(5)], "key long, text string").coalesce(1)
    wanted = suffix_dedup.repeated(docs, 100, 40)
    rows = suffix_dedup.stretches(docs, wanted.coalesce(1), 100, 40)
    assert rows.columns == ["key", "spot", "bytes"]
    assert {r.key for r in rows.coalesce(1).collect() if r.bytes is not None} == {0}


def test_spent_shuffles_of_suffixes_go_at_once(spark):
    """What was shuffled for a written table doesn't lie beside what the next steps shuffle, and the session's setting is as it was."""
    rng = np.random.default_rng(5)
    said = [" ".join(str(x) for x in rng.integers(0, 10**6, 600)) for _ in range(60)]
    docs = spark.createDataFrame([(i, said[i % 50]) for i in range(60)], "key long, text string").repartition(3)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: {p: os.path.getsize(p) for p in disk.getAllFiles().mkString("\n").split("\n") if os.path.basename(p).startswith("shuffle_")}
    before, set_before = left(), spark.conf.get(SPENT)
    runs = suffix_dedup.removable(docs)
    assert sum(n for name, n in left().items() if name not in before) < 20_000  # of 240 kB of text
    assert spark.conf.get(SPENT) == set_before
    assert {r.key for r in runs.collect()} == set(range(50, 60))
