"""Fits and joins that leave nothing out and nothing behind."""

import numpy as np
import pytest
import xxhash

from engram.llm import pii


@pytest.mark.parametrize("held", [pii.HELD, 0])
def test_pii_fits_on_every_candidate(spark, monkeypatch, held):
    """Over 5,000 candidates of a kind and label: the trees are those of all of them, summed in the driver or in the tasks."""
    monkeypatch.setitem(pii.Trees.__init__.__kwdefaults__, "rounds", 12)
    rng = np.random.default_rng(3)
    rows = [(i, f"n{i} call me at +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} or 1{rng.integers(10**5)} id a{rng.integers(10**9)}f" + " ann@site.com" * (i % 3 == 0)) for i in range(120)]
    x, y, check = [], [], []
    for d, t in rows:
        seed = xxhash.xxh3_64_intdigest(f"{d}:{t}".encode())
        for i, (f, label) in enumerate(pii.examples(t)):
            x.append(f)
            y.append(label)
            check.append(pii.in_check(seed, i))
    x, y, check = np.array(x, np.float32).astype(float), np.array(y, float), np.array(check)
    assert (y[x[:, 3] == 1] == 0).sum() > 5000
    cuts = [np.unique(np.quantile(x[~check, j], np.linspace(0, 1, 17)[1:-1], method="lower")) for j in range(x.shape[1])]
    b, n, kind = pii.binned(cuts, x), np.ones(len(y)), x[:, :4].argmax(axis=1)
    want = pii.Detector(x[:0], y[:0]).fit(pii.Trees(cuts, y[~check].mean(), lambda t, level: t.sums(b[~check], y[~check], n[~check], level)), lambda t: t.steps(b[check], y[check], n[check], kind[check]))
    monkeypatch.setattr(pii, "HELD", held)
    got = pii.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.threshold == want.threshold and min(got.threshold) < 1
    assert all((a == z).all() for s, t in zip(got.trees.trees, want.trees.trees, strict=True) for a, z in zip(s, t, strict=True))


def test_join_leaves_no_tables_of_postings_and_texts_behind(spark):
    """Of the tables that the join writes, those of prefixes, postings, signatures and shingles go when they were read."""
    import os

    from engram.llm import jaccard_join
    from engram.llm.common import new_folder

    rng = np.random.default_rng(5)
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 400)] for _ in range(300)]
    texts += [t[:390] + ["other"] for t in texts[:100]] + texts[:50]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    tables = os.path.dirname(new_folder(spark)).removeprefix("file:")
    held = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    out = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    new = [f"{d}/{f}" for x in set(os.listdir(tables)) - held for d, _, files in os.walk(f"{tables}/{x}") for f in files]
    assert sum(map(os.path.getsize, new)) < 150_000
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert got == {i: i if i < 300 else i - 300 if i < 400 else i - 400 for i in range(450)}
