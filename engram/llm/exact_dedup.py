"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by the length of the normalised text, survivors by a hash of its prefix, and only
survivors of both have their full content hashed. Groups are counted with partial aggregation, so a
group that holds a third of all rows arrives as one row per task; rows meet their group's result
in an equi-join whose hot partitions adaptive execution splits. No group is gathered in a task.

Defined results: a null text counts as empty; null ids sort after all others; of rows that repeat the same
id and the same text exactly one is kept, however often they repeat; texts of equal length tie to the smallest id; an empty table gives
an empty result; very long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, shielded, table

PREFIX, BLOCK = 256, 10_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _digests(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    text, norm = F.coalesce(F.col(text_col), F.lit("")), normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), norm.alias("_norm")).select(
        "doc_id", F.length("_text").cast("long").alias("_chars"), F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix)).alias("_prefix"), "_norm"
    )


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hash_all: bool = False, prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``hash_all``: also hash texts that no other text can equal, for callers who want every digest; they come
    from the one scan. Otherwise text_sha256 is null for them and their content is never hashed: the
    scan for full hashes is joined to the surviving (length, prefix hash) keys.
    """
    scan = _digests(docs, id_col, text_col, prefix)
    keys = ["_len", "_prefix"]
    rows = scan.select("doc_id", "_chars", *keys, *([F.sha2("_norm", 256).alias("_sha")] if hash_all else []))
    rows = cut(rows)
    # Written first, so that both sides of each join come from plain exchanges, whose hot partitions can be split.
    lengths = cut(rows.groupBy("_len").count().filter("count > 1").select("_len"))
    close = cut(rows.join(lengths, "_len", "left_semi"))
    prefixes = cut(close.groupBy(*keys).count().filter("count > 1").select(*keys))
    if hash_all:
        hashed = cut(close.join(prefixes, keys, "left_semi"))
    else:
        hashed = cut(scan.join(prefixes, keys, "left_semi").select("doc_id", "_chars", *keys, F.sha2("_norm", 256).alias("_sha")))
    first = F.struct((-F.col("_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    groups = hashed.groupBy(*keys, "_sha").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    groups = cut(groups.select(*keys, "_sha", F.col("_first.c").alias("_keep"), F.col("_n")))
    if not hash_all:
        alone = rows.join(prefixes, keys, "left_anti").withColumn("_sha", F.lit(None).cast("string"))
        rows = hashed.unionByName(alone)
    # Rows that repeat an id within a group can't be told apart: they are counted, then dealt out again, one of them kept.
    rows = rows.groupBy("doc_id", "_chars", *keys, "_sha").agg(F.count(F.lit(1)).alias("_same"))
    met = cut(cut(rows).join(groups, [*keys, "_sha"], "left"))
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    # A repeated id may occur with more than one spelling of the text; the one with most code points is kept.
    stays = keep.eqNullSafe(F.col("doc_id"))
    out = met.select("doc_id", keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), stays.alias("_stays"), "_chars", "_same", F.col("_sha").alias("text_sha256"), *keys)
    twice = out.filter("_stays").groupBy("keep_id", *keys, "text_sha256").agg(F.max("_chars").alias("_most"), F.count(F.lit(1)).alias("_ids")).filter("_ids > 1")
    twice = twice.select(F.col("keep_id").alias("_k"), F.col("_len").alias("_l"), F.col("text_sha256").alias("_s"), "_most")
    out = out.join(twice, F.col("keep_id").eqNullSafe(F.col("_k")) & (F.col("_len") == F.col("_l")) & F.col("text_sha256").eqNullSafe(F.col("_s")), "left")
    best = F.col("_stays") & (F.col("_most").isNull() | (F.col("_chars") == F.col("_most")))
    out = out.select("doc_id", "keep_id", "group_size", "text_sha256", best.alias("_best"), "_same")
    # Dealt out in two steps, so that no array grows with the number of repeats.
    out = out.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_same") - 1) / BLOCK).cast("long"))))
    start, end = F.col("_block") * BLOCK, F.least((F.col("_block") + 1) * BLOCK, F.col("_same"))
    out = out.withColumn("_i", F.explode(F.sequence(start + 1, end)))
    return out.select("doc_id", "keep_id", "group_size", (F.col("_best") & (F.col("_i") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = PREFIX) -> DataFrame:
    """``docs`` without the copies, all columns as they came.

    Ids that occur once are kept or dropped by a join on the id. Rows of ids that occur more than once are
    settled by comparing normalised texts among those rows only.
    """
    docs, new, back = shielded(docs)
    id_col, text_col = new[id_col], new[text_col]
    verdicts = cut(decide(docs, id_col, text_col, prefix=prefix))
    ids = verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col("kept").cast("long")).alias("_kept"))
    drop = cut(ids.filter("_rows > 1 or _kept = 0").select(F.col("doc_id").alias("_id"), "_rows"))
    if not drop.filter("_rows > 1").take(1):  # every id occurs once: the texts move once, in an anti-join
        return back(docs.join(drop, F.col(id_col).eqNullSafe(F.col("_id")), "left_anti"))
    met = docs.join(drop, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    single = met.filter("_rows is null").select(*docs.columns)
    again = met.filter("_rows > 1").select(*docs.columns, F.sha2(normalised(F.col(text_col)), 256).alias("_sha"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_chars"))
    again = again.groupBy(F.col(id_col).alias("_id"), "_sha").agg(F.max_by(F.struct(*docs.columns), "_chars").alias("_row"))
    gone = verdicts.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("_any")).filter("text_sha256 is not null and not _any")
    again = again.join(gone, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("text_sha256")), "left_anti")
    return back(single.unionByName(again.select("_row.*")))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document with the document that stays in its place."""
    out = decide(table(spark, sf_dir, "documents"), hash_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
with n as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size, row_number() over w = 1 as kept, text_sha256
from n window w as (partition by text_sha256 order by chars desc, doc_id nulls last rows between unbounded preceding and unbounded following)
"""
