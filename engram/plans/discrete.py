"""Discrete codes and their searches, with recall against the exact search; exact tests of paired outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import codes, metrics
from ..sources.entries import query_vectors, table, vectors
from .base import query
from .vectors import BEST

#: Of 64 entries, the strongest eleven; the sixteen highest and lowest.
STRONGEST, ENDS = 11, 16

_RANKED = "list_slice(list_sort(list_transform(range(1, 65), lambda i: {{'v': {value}, 'i': i}})), 1, {k})"
_BITS = "list_transform(range(1, 65), lambda i: case when {test} then 1 else 0 end)"
_PACK = "[list_reduce(list_concat([0::bigint], list_slice({b}, 1, 32)), lambda s, x: s * 2 + x), list_reduce(list_concat([0::bigint], list_slice({b}, 33, 64)), lambda s, x: s * 2 + x)]"
KWTA = f"k as (select vec_id as memory_id, list_transform({_RANKED.format(value='-abs(embedding[i]::double)', k=STRONGEST)}, lambda s: s.i) as pos from embeddings)"
TRI = f"t as (select memory_id, list_filter(hi, lambda i: not list_contains(lo, i)) as plus, lo as minus from (select vec_id as memory_id, list_transform({_RANKED.format(value='-embedding[i]::double', k=ENDS)}, lambda s: s.i) as hi, list_transform({_RANKED.format(value='embedding[i]::double', k=ENDS)}, lambda s: s.i) as lo from embeddings))"
OVERLAP = "s as (select a.memory_id as query_id, b.memory_id, len(list_intersect(a.pos, b.pos))::integer as score from k a, k b where a.memory_id % 50 = 0)"
DOT = "s as (select a.memory_id as query_id, b.memory_id, (len(list_intersect(a.plus, b.plus)) + len(list_intersect(a.minus, b.minus)) - len(list_intersect(a.plus, b.minus)) - len(list_intersect(a.minus, b.plus)))::integer as score from t a, t b where a.memory_id % 50 = 0)"
TOP = "r as (select *, row_number() over (partition by query_id order by score desc, memory_id) - 1 as rank from s)"
AGREE = f"x as (select query_id, memory_id, r - 1 as rank from ({BEST}) where r <= 5), p as (select x.query_id, count(r.rank) / 5 as share, max(case when r.rank = 0 and x.rank = 0 then 1.0 else 0.0 end) as same from x left join (select * from r where rank < 5) r using (query_id, memory_id) group by x.query_id) select count(*) as queries, round(avg(share), 6)::double as recall, round(avg(same), 6)::double as first from p"


def coded(spark, d, kind):
    code = codes.strongest(F.col("embedding"), STRONGEST) if kind == "overlap" else codes.ternary(F.col("embedding"), ENDS)
    return vectors(spark, d).select("memory_id", code.alias("code"))


def search(spark, d, kind, k):
    c = coded(spark, d, kind)
    return codes.nearest_by(c, c.filter("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id"), k, kind)


@query("C9_kwta", f"with {KWTA}, b as (select memory_id, {_BITS.format(test='list_contains(pos, i)')} as b from k) select memory_id, {_PACK.format(b='b')} as code from b", entries=False)
def kwta(spark, d):
    return coded(spark, d, "overlap")


@query("C9_ternary", f"with {TRI}, b as (select memory_id, {_BITS.format(test='list_contains(plus, i) or list_contains(minus, i)')} as m, {_BITS.format(test='list_contains(plus, i)')} as p from t) select memory_id, list_concat({_PACK.format(b='m')}, {_PACK.format(b='p')}) as code from b", entries=False)
def ternary(spark, d):
    return coded(spark, d, "ternary")


@query("C9_sign", f"with b as (select vec_id as memory_id, {_BITS.format(test='embedding[i] > 0')} as b from embeddings) select memory_id, {_PACK.format(b='b')} as code from b", entries=False)
def sign(spark, d):
    return vectors(spark, d).select("memory_id", V.sign_code(F.col("embedding")).alias("code"))


@query("C10_overlap", f"with {KWTA}, {OVERLAP}, {TOP} select query_id, memory_id, score, rank::integer as rank from r where rank < 5", entries=False)
def overlap(spark, d):
    return search(spark, d, "overlap", 5)


@query("C10_ternary", f"with {TRI}, {DOT}, {TOP} select query_id, memory_id, score, rank::integer as rank from r where rank < 5", entries=False)
def ternary_top(spark, d):
    return search(spark, d, "ternary", 5)


def agree(spark, d, kind):
    out = codes.agreement(search(spark, d, kind, 5), V.nearest(vectors(spark, d), query_vectors(spark, d), 5), 5)
    return out.select("queries", F.round("recall", 6).alias("recall"), F.round("first", 6).alias("first"))


@query("C10_overlap_recall", f"with {KWTA}, {OVERLAP}, {TOP}, {AGREE}", entries=False)
def overlap_recall(spark, d):
    return agree(spark, d, "overlap")


@query("C10_ternary_recall", f"with {TRI}, {DOT}, {TOP}, {AGREE}", entries=False)
def ternary_recall(spark, d):
    return agree(spark, d, "ternary")


@query("F17_exact_p", "with c as (select count(*) filter (quality = 1 and toxic = 1) as both_true, count(*) filter (quality = 1 and toxic <> 1) as only_a, count(*) filter (quality <> 1 and toxic = 1) as only_b, count(*) filter (quality <> 1 and toxic <> 1) as none_true from labels) select both_true, only_a, only_b, none_true, round(least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))), 9)::double as p from c", entries=False)
def exact_p(spark, d):
    """Whether good quality and toxicity are marked equally often, on the labels that have one but not the other."""
    o = table(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return metrics.paired(o, "a", "b").withColumn("p", F.round("p", 9))
