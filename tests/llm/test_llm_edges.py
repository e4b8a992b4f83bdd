"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import pytest
from pyspark.sql import functions as F

from engram.llm import chat_format, decontaminate, exact_dedup, jaccard_join, language_id, packing, pii, quality, substring_dedup, token_counts

LONG = " ".join(f"word{i % 700} {i}" for i in range(3000))
ROWS = [(1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, LONG, "en"), (5, LONG, "de"), (5, LONG, "de"), (None, "le petit chat noir dort ici", "fr"), (None, None, None), (6, "the quick brown fox jumps over the lazy dog " * 3, "en"), (7, "x" * 5000, "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, sid string, _id string, th string, comp string, h string, count long, score string, _score string, _n_words string, _rows string, engram_0 string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, c, "s", 1, "w", "q", "z", "t", "c", "h", 9, "s", "a", "b", "c", "d") for a, b, c in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, docs):
    """The same rows, and empty tables, as folders of Parquet."""
    out = {}
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, None), (3, "..."), (None, "jumps over the lazy dog the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    conv = spark.createDataFrame([(1, 0, "user", "hi <|im_end|> <\\| x"), (1, 1, "assistant", None), (1, 1, None, "tie"), (2, 0, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    for name, cut in (("full", False), ("empty", True)):
        d = str(tmp_path_factory.mktemp(name))
        for t, df in (("documents", docs), ("labels", labels), ("benchmark", bench), ("conversations", conv)):
            (df.limit(0) if cut else df).write.parquet(f"{d}/{t}.parquet")
        out[name] = d
    return out


@pytest.mark.parametrize("module", [pii, language_id, packing, quality, exact_dedup, decontaminate, substring_dedup, token_counts, jaccard_join], ids=lambda m: m.__name__.rpartition(".")[2])
def test_every_row_comes_back_once(spark, tables, module):
    got = module.query(spark, tables["full"])
    if module is packing:
        got = got.filter("piece = 0")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect()) == sorted((a is None, a or 0) for a, _, _ in ROWS)
    assert module.query(spark, tables["empty"]).count() == 0


def test_defined_results(spark, tables):
    d = tables["full"]
    lang = language_id.query(spark, d).filter("doc_id in (1, 2, 3)").collect()
    assert {(r.lang_pred, r.score) for r in lang} == {("und", 0.0)}
    dedup = exact_dedup.query(spark, d).collect()
    blank = [r for r in dedup if r.group_size == 4]
    assert {r.keep_id for r in blank} == {3} and sum(r.kept for r in blank) == 1  # the blank text has most code points
    same = [r for r in dedup if r.keep_id == 4]
    assert [r.group_size for r in same] == [3, 3, 3] and [r.doc_id for r in same if r.kept] == [4]
    sub = {r.doc_id: r for r in substring_dedup.query(spark, d).collect()}
    assert sub[4].n_removed == sub[4].n_words == 6000 and sub[6].n_removed == 0 and sub[1].n_words == 0
    near = {r.doc_id: r.component_id for r in jaccard_join.query(spark, d).collect()}
    assert near[5] == 4 and near[1] == 1 and near[3] == 3
    hit = {r.doc_id: r for r in decontaminate.query(spark, d).collect()}
    assert hit[6].n_items == 2 and hit[6].contaminated and not hit[1].contaminated and hit[4].n_hit == 0
    chat = {r.conv_id: r for r in chat_format.query(spark, d).collect()}
    assert chat[1].n_turns == 3 and chat[1].loss_chars == 0 and chat[2].loss_chars == 2 and chat[-1].loss_chars == 34
    packed = packing.query(spark, d).collect()
    assert {(r.piece, r.length) for r in packed if r.doc_id == 1} == {(0, 1)}


def test_filters_keep_columns_and_one_row_of_repeats(spark, docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").select("doc_id").collect()) == [3, 4, 6, 7]
    one = jaccard_join.keep_one(docs)
    assert one.columns == docs.columns
    assert [r.doc_id for r in one.filter("doc_id in (4, 5)").select("doc_id").collect()] == [4]
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.filter("doc_id = 6").count() == 0 and clean.count() == len(ROWS) - 1
    good = quality.keep_good(docs, quality.train(docs, spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int")))
    assert good.columns == docs.columns and good.count() in (0, len(ROWS))  # two labels: one rate for all
    assert exact_dedup.keep_first(docs.filter(F.lit(False))).count() == 0


def test_one_row_of_each_component_with_null_and_reused_ids(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(0, x + " end"), (1, x), (1, y), (2, y + " end"), (None, z), (None, z + " end"), (None, z), (None, "alone in the world"), (None, y.upper()), (None, ""), (3, " "), (3, " ")]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kept = [(r.doc_id, r.text) for r in got]
    alike = [r for r in kept if r[1].startswith("z0 ")]
    assert len(alike) == 1 and alike[0][0] is None
    assert sorted((r for r in kept if r not in alike), key=str) == sorted([(0, x + " end"), (1, y), (None, "alone in the world"), (None, ""), (3, " ")], key=str)
