"""Vector queries (group C) and joins by similarity (group E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import graph, recall
from ..sources.entries import entries, query_vectors, table, vectors
from .base import query

COS = "(list_dot_product(a.embedding::double[], b.embedding::double[]) / ((sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) + 1e-8) * (sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) + 1e-8)))"
BEST = f"select a.vec_id as query_id, b.vec_id as memory_id, {COS} as sim, row_number() over (partition by a.vec_id order by {COS} desc, b.vec_id) as r from embeddings a, embeddings b where a.vec_id % 50 = 0"
CODE = "list_sum(list_transform(range(1, 65), lambda i: case when (a.embedding[i] > 0) <> (b.embedding[i] > 0) then 1 else 0 end))"


@query("C2_cosine", f"select a.vec_id as a, b.vec_id as b, round({COS}, 5) as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1", entries=False)
def cosine(spark, d):
    v = vectors(spark, d)
    nxt = v.select((F.col("memory_id") - 1).alias("memory_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "memory_id").select(F.col("memory_id").alias("a"), (F.col("memory_id") + 1).alias("b"), F.round(V.cosine(F.col("embedding"), F.col("other")), 5).alias("sim"))


@query("C3_best_chunk", f"select b.vec_id as memory_id, a.label as grp, round(max({COS}), 5) as sim from embeddings a, embeddings b where a.vec_id % 50 = 0 group by b.vec_id, a.label", entries=False)
def best_chunk(spark, d):
    v = vectors(spark, d)
    asked = v.filter("memory_id % 50 = 0").select("embedding", F.col("label").alias("grp"))
    return V.best_by(v, asked, "grp").withColumn("sim", F.round("sim", 5))


@query("C4_normalised", "select vec_id as memory_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as length, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as first from embeddings", entries=False)
def normalised(spark, d):
    return vectors(spark, d).select("memory_id", F.round(V.norm(F.col("embedding")), 5).alias("length"), F.round(F.element_at(V.normalised(F.col("embedding")), 1), 5).alias("first"))


@query("C8_hamming", f"select query_id, memory_id, ham from (select a.vec_id as query_id, b.vec_id as memory_id, {CODE}::integer as ham, row_number() over (partition by a.vec_id order by {CODE}, b.vec_id) as r from embeddings a, embeddings b where a.vec_id % 50 = 0) where r <= 10", entries=False)
def hamming(spark, d):
    return near_codes(spark, d, 10).select("query_id", "memory_id", "ham")


def near_codes(spark, d, k):
    coded = vectors(spark, d).select("memory_id", V.sign_code(F.col("embedding")).alias("code"))
    return V.nearest_codes(coded, coded.filter("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id"), k)


@query("C9_codes", "select vec_id as memory_id, list_sum(list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end))::integer as ones from embeddings", entries=False)
def codes(spark, d):
    return vectors(spark, d).select("memory_id", F.aggregate(V.sign_code(F.col("embedding")), F.lit(0), lambda s, x: s + F.bit_count(x)).alias("ones"))


@query("C10_float_topk", f"select query_id, memory_id, round(sim, 5) as sim from ({BEST}) where r <= 10", entries=False)
def float_topk(spark, d):
    return V.nearest(vectors(spark, d), query_vectors(spark, d), 10).select("query_id", "memory_id", F.round("sim", 5).alias("sim"))


@query("C11_noise")
def noise(spark, d):
    """Agreement of the nearest row when every second dimension of the query is masked."""
    v, asked = vectors(spark, d), query_vectors(spark, d)
    masked = asked.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.lit(0).cast("float"))))
    a, b = (V.nearest(v, q, 1).select("query_id", F.col("memory_id").alias(n)) for q, n in ((asked, "full"), (masked, "masked")))
    return a.join(b, "query_id").agg(F.count(F.lit(1)).alias("queries"), F.avg((F.col("full") == F.col("masked")).cast("double")).alias("agree"))


@query("C12_overlap_code", f", x as (select vec_id, list_sort(list_transform(list_slice(list_sort(list_transform(range(1, 65), lambda i: {{'v': -embedding[i]::double, 'i': i - 1}})), 1, 16), lambda s: s.i)) as code from embeddings) select a.vec_id as a, b.vec_id as b, len(list_intersect(a.code, b.code))::integer as shared from x a join x b on b.vec_id = a.vec_id + 1".removeprefix(", ").join(("with ", "")), entries=False)
def overlap_code(spark, d):
    v = vectors(spark, d).select("memory_id", V.top_code(F.col("embedding"), 16).alias("code"))
    nxt = v.select((F.col("memory_id") - 1).alias("memory_id"), F.col("code").alias("other"))
    return v.join(nxt, "memory_id").select(F.col("memory_id").alias("a"), (F.col("memory_id") + 1).alias("b"), F.size(F.array_intersect("code", "other")).alias("shared"))


PAIRS = f"select a.vec_id as a, b.vec_id as b, {COS} as sim from embeddings a join embeddings b on a.vec_id < b.vec_id where {COS} >= 0.38"


LATER = f", v as (select memory_id, text, ts, embedding from e join embeddings on vec_id = memory_id where superseded_by is null), lp as (select a.memory_id as a, b.memory_id as b, a.text as s, b.text as t, a.ts, {COS} as sim, row_number() over (partition by a.memory_id order by round({COS}, 9) desc, b.ts desc, b.memory_id) as rank from v a join v b on b.ts < a.ts or (b.ts = a.ts and b.memory_id > a.memory_id) where {COS} >= 0.38)"
CONFLICTS = LATER + ", cp as (select * from lp where rank <= 5 and coalesce(s, '') <> coalesce(t, ''))"


def live_pairs(spark, d):
    """Active entries, their vectors and the similar pairs among them."""
    live = entries(spark, d).filter("superseded_by is null")
    v = vectors(spark, d).join(live.select("memory_id"), "memory_id", "left_semi")
    return live, v, graph.similar_pairs(v, 0.38)


@query("E4_near_pairs", CONFLICTS + " select a, b, round(sim, 5) as sim, rank::integer as rank from cp")
def near_pairs(spark, d):
    live, _, pairs = live_pairs(spark, d)
    return graph.conflicts(pairs, live).select("a", "b", F.round("sim", 5).alias("sim"), "rank")


@query("E5_nearest", f"select query_id, memory_id from (select query_id, memory_id, row_number() over (partition by query_id order by sim desc, memory_id) as r from ({BEST}) where query_id <> memory_id) where r = 1", entries=False)
def nearest_other(spark, d):
    s = V.nearest(vectors(spark, d), query_vectors(spark, d), 2).filter("query_id <> memory_id")
    return recall.top(s.drop("rank"), [F.desc("sim"), F.col("memory_id")], 1, ["query_id"]).select("query_id", "memory_id")


@query("E14_evict_keep", f"select b.vec_id as memory_id, round(max({COS}), 5) as sim from embeddings a join embeddings b on a.vec_id % 7 <> 0 and b.vec_id % 7 = 0 group by b.vec_id", entries=False)
def evict_keep(spark, d):
    v = vectors(spark, d)
    s = V.nearest(v.filter("memory_id % 7 <> 0"), v.filter("memory_id % 7 = 0").select(F.col("memory_id").alias("query_id"), "embedding"), 1)
    return s.select(F.col("query_id").alias("memory_id"), F.round("sim", 5).alias("sim"))


COMPONENTS = f"with recursive p as ({PAIRS}), ed as (select a, b from p union all select b, a from p), reach as (select vec_id as memory_id, vec_id as other from embeddings union select reach.memory_id, ed.b from reach join ed on reach.other = ed.a), c as (select memory_id, min(other) as cluster from reach group by memory_id)"


@query("K1_clusters", f"{COMPONENTS} select memory_id, cluster from c", entries=False)
def clusters(spark, d):
    v = vectors(spark, d)
    return graph.clusters(v, 0.38)


@query("K2_find_clusters", LATER + ", ed as (select a, b from lp where rank <= 8 union all select b, a from lp where rank <= 8), reach as (select memory_id, memory_id as other from v union select reach.memory_id, ed.b from reach join ed on reach.other = ed.a), c as (select memory_id, min(other) as cluster from reach group by memory_id) select cluster, count(*) as size, max(ts) as newest from c join v using (memory_id) group by cluster having count(*) >= 2")
def find_clusters(spark, d):
    """Components of active entries' eight nearest later ones at a floor, two members or more."""
    live, v, pairs = live_pairs(spark, d)
    c = graph.components(v, graph.later_neighbours(pairs, live, 8)).join(live.select("memory_id", "ts"), "memory_id")
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max("ts").alias("newest")).filter("size >= 2")


@query("K6_percolation", f"{COMPONENTS}, s as (select cluster, count(*) as n from c group by cluster) select count(*) as clusters, max(n) as largest, round(max(n) / sum(n), 6)::double as share from s", entries=False)
def percolation(spark, d):
    v = vectors(spark, d)
    s = graph.clusters(v, 0.38).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("F20_neighbour_spread", f"select width_bucket_ as bin, count(*) as n from (select cast(floor(greatest(0, least(15, (s - 0.1) / 0.05))) as integer) as width_bucket_ from (select a.vec_id, max({COS}) as s from embeddings a join embeddings b on a.vec_id <> b.vec_id group by a.vec_id)) group by 1", entries=False)
def spread(spark, d):
    v = vectors(spark, d)
    s = V.nearest(v, v.select(F.col("memory_id").alias("query_id"), "embedding"), 2).filter("query_id <> memory_id").groupBy("query_id").agg(F.max("sim").alias("s"))
    return s.select(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(15.0), (F.col("s") - 0.1) / 0.05))).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("F21_coverage", f", deg as (select x.vec_id, count(p.a) as n from embeddings x left join (select a, b from p union all select b, a from p) p on p.a = x.vec_id group by x.vec_id) select n as degree, count(*) as members from deg group by n".join((f"with p as ({PAIRS})", "")), entries=False)
def coverage(spark, d):
    v, p = vectors(spark, d), graph.similar_pairs(vectors(spark, d), 0.38)
    both = p.select(F.col("a").alias("memory_id")).unionByName(p.select(F.col("b").alias("memory_id"))).groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    return v.join(both, "memory_id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("degree")).agg(F.count(F.lit(1)).alias("members"))


@query("F29_class_radius", "with x as (select label, i, avg(v) as c from (select label, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) as i from embeddings) group by label, i) select label, round(sqrt(sum(c * c)), 5) as radius from x group by label", entries=False)
def class_radius(spark, d):
    x = vectors(spark, d).select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("c"))
    return x.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("c") * F.col("c"))), 5).alias("radius"))


FID = f"with t as ({BEST}), h as (select a.vec_id as query_id, b.vec_id as memory_id, row_number() over (partition by a.vec_id order by {CODE}, b.vec_id) as r from embeddings a, embeddings b where a.vec_id % 50 = 0)"


@query("F11_fidelity", FID + " select t.query_id, round(count(h.r) / count(*), 6)::double as fidelity from t left join (select * from h where r <= 250) h on h.query_id = t.query_id and h.memory_id = t.memory_id where t.r <= 100 group by t.query_id", entries=False)
def fidelity(spark, d):
    from ..operators import metrics

    return metrics.overlap(V.nearest(vectors(spark, d), query_vectors(spark, d), 100), near_codes(spark, d, 250)).select("query_id", F.round("fidelity", 6).alias("fidelity"))
