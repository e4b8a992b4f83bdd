"""Further source, vector, metric, ranking, composite and legacy queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lenient
from ..functions import text as T
from ..functions import vector as V
from ..operators import consolidate as C
from ..operators import graph, hopfield, lexical, lifecycle, metrics, recall
from ..sources import store
from ..sources.entries import NOW, entries, query_vectors, table, vectors
from .base import query
from .memory import ASKED, DW, HYBRID, TAU, asked, eviction, hybrid
from .vectors import BEST, CODE, COMPONENTS, CONFLICTS, COS, PAIRS, live_pairs, near_codes

# Sources and sinks.


@query("A1_library", "select memory_id, source from e")
def library(spark, d):
    """Saved as a version and loaded through the pointer."""
    graph.checkpointed(spark.range(1))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    lib = store.Library(spark, f"{folder}/library-{uuid.uuid4().hex}")
    lib.save(entries(spark, d))
    return lib.load().select("memory_id", "source")


@query("A5_embeddings")
def rebuilt(spark, d):
    return entries(spark, d).select("memory_id", lenient.embed(F.array_sort(T.tokens(F.col("text")))).alias("embedding"))


@query("A7_sessions", "select conv_id, turn, md5(role || ': ' || text) as line from conversations", entries=False)
def session_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.concat_ws(": ", "role", "text")).alias("line"))


@query("A9_needed", "select event_id from events where user_id in (select c_custkey from customer where c_custkey % 3 = 0)", entries=False)
def needed(spark, d):
    ids = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(ids, "user_id", "left_semi").select("event_id")


@query("A10_states", "select page_id, md5(concat_ws(chr(10), url, case when length(html) < 1500 then html end)) as entry from pages", entries=False)
def states(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.concat_ws("\n", "url", F.when(F.length("html") < 1500, F.col("html")))).alias("entry"))


@query("A11_best_effort", "select event_id, coalesce(nullif(event_type, 'click'), 'user ' || user_id) as text from events", entries=False)
def best_effort(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("click")), F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("text"))


@query("A15_repaired", "select event_id, epoch(coalesce(case when event_id % 5 <> 0 then ts end, min(ts) over (partition by user_id)))::double as at from events", entries=False)
def repaired(spark, d):
    ev = table(spark, d, "events")
    first = ev.groupBy("user_id").agg(F.min("ts").alias("first"))
    fixed = ev.withColumn("ts", F.when(F.col("event_id") % 5 != 0, F.col("ts"))).join(first, "user_id")
    return fixed.select("event_id", (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.coalesce("ts", "first")) / 1e6).alias("at"))


@query("A19_overlay", "select 'turn' as kind, count(*) as n from e union all select 'state', count(distinct nullif(lower(trim(state_key)), '')) from e")
def overlay(spark, d):
    e = entries(spark, d)
    turn = e.select(F.lit("turn").alias("kind"), F.col("memory_id").cast("string").alias("x"))
    state = e.filter("state_key is not null").select(F.lit("state").alias("kind"), T.state_key(F.col("state_key")).alias("x")).distinct()
    return turn.unionByName(state).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Functions that need Python.


@query("B15_json", "select event_id, user_id from events", entries=False)
def parsed(spark, d):
    """Objects cut off before their end are closed and read."""
    raw = F.concat(F.lit("Result: {\"user\": "), F.col("user_id").cast("string"), F.lit(", \"list\": [1, 2"))
    return table(spark, d, "events").select("event_id", F.get_json_object(lenient.lenient_json(raw), "$.user").cast("long").alias("user_id"))


@query("B16_arithmetic", "select o_orderkey, (o_orderkey + 3) * 2 - o_custkey / 4.0::double as v from orders", entries=False)
def arithmetic(spark, d):
    expr = F.format_string("(%d + 3) * 2 - %d / 4", "o_orderkey", "o_custkey")
    return table(spark, d, "orders").select("o_orderkey", lenient.arithmetic(expr).alias("v"))


# Vectors.


@query("C12_pattern_step", ", p as (select vec_id as memory_id, i, case when embedding[i + 1] > 0 then 1 else -1 end as v from embeddings, range(64) r(i)), m as (select a.memory_id as query_id, b.memory_id, sum(a.v * b.v) as m from p a join p b on a.i = b.i where a.memory_id % 50 = 0 group by 1, 2) select query_id, p.i::integer as i, case when sum(m * v) >= 0 then 1 else -1 end as v from m join p using (memory_id) group by 1, 2".replace(", p as", "with p as", 1), entries=False)
def pattern_step(spark, d):
    p = patterns(spark, d)
    done = hopfield.recall_step(p, p.filter("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id"))
    return done.select("query_id", F.posexplode("code").alias("i", "v"))


def patterns(spark, d):
    return vectors(spark, d).select("memory_id", hopfield.signs(F.col("embedding")).alias("code"))


@query("C13_routed", "select memory_id, ('0x' || substr(md5(text), 1, 7))::bigint % 8 as compartment from e")
def routed(spark, d):
    return entries(spark, d).select("memory_id", (F.conv(F.substring(F.md5("text"), 1, 7), 16, 10).cast("long") % 8).alias("compartment"))


@query("C15_associate")
def associate(spark, d):
    """What a settled state overlaps most, the row itself left out."""
    p = patterns(spark, d)
    done = hopfield.settle(p, p.filter("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id"), 3)
    near = V.nearest(p.withColumnRenamed("code", "embedding"), done.select("query_id", F.col("code").alias("embedding")), 6, floor=1e-6).filter("query_id <> memory_id")
    return recall.top(near.drop("rank"), [F.desc("sim"), F.col("memory_id")], 5, ["query_id"])


@query("C18_kmeans")
def kmeans(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, d).withColumn("features", array_to_vector("embedding"))
    model = KMeans(k=10, seed=42, distanceMeasure="cosine", maxIter=25).fit(v)
    return model.transform(v).select("memory_id", F.col("prediction").alias("cluster"))


@query("D10_similar_other_text", f"select a, b, round(sim, 5) as sim from ({PAIRS}) p join e x on x.memory_id = p.a join e y on y.memory_id = p.b where x.text <> y.text")
def similar_other_text(spark, d):
    """All similar pairs but those of equal texts, whatever the texts begin with. Texts move once, as digests."""
    s = entries(spark, d).filter("text is not null").select("memory_id", F.sha2("text", 256).alias("s"))
    p = graph.similar_pairs(vectors(spark, d), 0.38)
    x, y = s.select(F.col("memory_id").alias("a"), "s"), s.select(F.col("memory_id").alias("b"), F.col("s").alias("t"))
    return p.join(x, "a").join(y, "b").filter("s <> t").select("a", "b", F.round("sim", 5).alias("sim"))


@query("E1_scored", f"select a.vec_id as query_id, b.vec_id as memory_id, round({COS}, 5) as sim from embeddings a, embeddings b where a.vec_id % 50 = 0 and {COS} >= 0.2", entries=False)
def scored(spark, d):
    v = vectors(spark, d)
    return V.nearest(v, query_vectors(spark, d), None, floor=0.2).select("query_id", "memory_id", F.round("sim", 5).alias("sim"))


@query("E13_gold", "select conv_id, len(list_intersect(list(turn) filter (role = 'user'), list(turn) filter (turn < 2)))::integer as hits from conversations group by conv_id", entries=False)
def gold(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("p"), F.collect_list(F.when(F.col("turn") < 2, F.col("turn"))).alias("g"))
    return c.select("conv_id", F.size(F.array_intersect("p", "g")).alias("hits"))


# Metrics.


@query("F5_known_idf", f", {ASKED}, k as (select query_id, sum(idf) as known from w where df is not null group by query_id) select query_id, memory_id, round(least(raw / known, 1.0), 6) as score from lex join k using (query_id)")
def known_idf(spark, d):
    e = entries(spark, d)
    return lexical.scores(e, asked(e), "known", digits=6)


@query("F12_code_recall", f"with t as ({BEST}), h as (select a.vec_id as query_id, b.vec_id as memory_id, row_number() over (partition by a.vec_id order by {CODE}, b.vec_id) as r from embeddings a, embeddings b where a.vec_id % 50 = 0) select t.query_id, round(count(h.r) / count(*), 6)::double as fidelity from t left join (select * from h where r <= 5) h on h.query_id = t.query_id and h.memory_id = t.memory_id where t.r <= 5 group by t.query_id", entries=False)
def code_recall(spark, d):
    return metrics.overlap(V.nearest(vectors(spark, d), query_vectors(spark, d), 5), near_codes(spark, d, 5)).select("query_id", F.round("fidelity", 6).alias("fidelity"))


@query("F15_mutations", "select count(*) filter (quality = 0 and toxic = 0) as unnecessary, count(*) filter (quality = 1 and toxic = 1) as missed, count(*) filter (toxic = 1) as failed from labels", entries=False)
def mutations(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, d, "labels").agg(F.count_if(~q & ~t).alias("unnecessary"), F.count_if(q & t).alias("missed"), F.count_if(t).alias("failed"))


@query("F22_component_sizes", f"{COMPONENTS}, s as (select cluster, count(*) as n from c group by cluster) select n as size, count(*) as clusters from s group by n", entries=False)
def component_sizes(spark, d):
    v = vectors(spark, d)
    s = graph.clusters(v, 0.38).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return s.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


@query("F23_recoverable", f"select round(avg(case when s >= 0.3 then 1 else 0 end), 6)::double as recoverable from (select b.vec_id, max({COS}) as s from embeddings a join embeddings b on a.vec_id % 7 <> 0 and b.vec_id % 7 = 0 group by b.vec_id)", entries=False)
def recoverable(spark, d):
    v = vectors(spark, d)
    s = V.nearest(v.filter("memory_id % 7 <> 0"), v.filter("memory_id % 7 = 0").select(F.col("memory_id").alias("query_id"), "embedding"), 1)
    return s.agg(F.round(F.avg((F.col("sim") >= 0.3).cast("int")), 6).alias("recoverable"))


@query("F24_lineage_kept", ", r as (select memory_id, superseded_by as successor from e where superseded_by is not null union all select r.memory_id, e.superseded_by from r join e on r.successor = e.memory_id and e.superseded_by is not null) select a.lang = b.lang as same, count(*) as n from r join e a on a.memory_id = r.memory_id join e b on b.memory_id = r.successor group by 1")
def lineage_kept(spark, d):
    e = entries(spark, d)
    r = graph.ancestry(e.select("memory_id", "superseded_by"))
    a, b = e.select("memory_id", F.col("lang").alias("x")), e.select(F.col("memory_id").alias("successor"), F.col("lang").alias("y"))
    return r.join(a, "memory_id").join(b, "successor").groupBy((F.col("x") == F.col("y")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("F26_policies", f"{HYBRID}, r as (select query_id, memory_id, superseded_by, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id)), per as (select query_id, max(case when rank = 1 and superseded_by is null then 1 else 0 end) as current1, max(case when rank <= 3 and superseded_by is null then 1 else 0 end) as current3, max(case when rank = 1 and superseded_by is not null then 1 else 0 end) as stale1 from r where rank <= 3 group by query_id) select sum(current1)::bigint as current1, sum(current3)::bigint as current3, sum(stale1)::bigint as stale1 from per")
def policies(spark, d):
    h, v, q, qv = hybrid(spark, d)
    r = recall.recall(h, v, q, qv, 3, superseded=True).join(h.select("memory_id", "superseded_by"), "memory_id")
    live, one = F.col("superseded_by").isNull(), F.col("rank") == 1
    per = r.groupBy("query_id").agg(F.max((one & live).cast("long")).alias("current1"), F.max(live.cast("long")).alias("current3"), F.max((one & ~live).cast("long")).alias("stale1"))
    return per.agg(*(F.sum(c).alias(c) for c in ("current1", "current3", "stale1")))


@query("F27_storage", "select count(*) * 64 * 4 as float_bytes, count(*) * 8 as sign_bytes, 32.0::double as ratio from embeddings", entries=False)
def storage(spark, d):
    n = F.sum(F.size("embedding"))
    return vectors(spark, d).agg((n * 4).alias("float_bytes"), F.floor(n / 8).alias("sign_bytes")).withColumn("ratio", F.col("float_bytes") / F.col("sign_bytes"))


# Ranking.


@query("G10_batches", f"with recursive t as ({BEST}), b as (select query_id, floor(memory_id / 20)::bigint as batch, max(sim) as best from t where r <= 30 group by 1, 2), k as (select *, row_number() over (partition by query_id order by best desc, batch) as rank from b) select query_id, batch, rank from k where rank <= 3", entries=False)
def hit_batches(spark, d):
    s = V.nearest(vectors(spark, d), query_vectors(spark, d), 30).groupBy("query_id", F.floor(F.col("memory_id") / 20).alias("batch")).agg(F.max("sim").alias("best"))
    return recall.top(s, [F.desc("best"), F.col("batch")], 3, ["query_id"]).select("query_id", "batch", F.col("rank").cast("long").alias("rank"))


@query("G11_neighbours", f"select query_id, memory_id from (select a.vec_id as query_id, b.vec_id as memory_id, row_number() over (partition by a.vec_id order by {COS} desc, b.vec_id) as r from embeddings a join embeddings b on a.vec_id <> b.vec_id) where r <= 5", entries=False)
def neighbours(spark, d):
    v = vectors(spark, d)
    s = V.nearest(v, v.select(F.col("memory_id").alias("query_id"), "embedding"), 6).filter("query_id <> memory_id").drop("rank")
    return recall.top(s, [F.desc("sim"), F.col("memory_id")], 5, ["query_id"]).select("query_id", "memory_id")


@query("G12_newest", f"{COMPONENTS} select cluster, count(*) as size, min(memory_id) as newest from c join documents on doc_id = memory_id group by cluster", entries=False)
def newest(spark, d):
    """Entry times fall with the id, so the newest member is the one of the smallest id."""
    v = vectors(spark, d)
    return graph.newest_in_cluster(graph.clusters(v, 0.38), entries(spark, d))


@query("G15_repick", f"select query_id, min(memory_id) as memory_id from ({BEST}) join documents on doc_id = memory_id where r <= 3 group by query_id", entries=False)
def repick(spark, d):
    s = V.nearest(vectors(spark, d), query_vectors(spark, d), 3).join(entries(spark, d).select("memory_id", "ts"), "memory_id")
    return s.groupBy("query_id").agg(F.max(F.struct("ts", "memory_id")).alias("m")).select("query_id", "m.memory_id")


@query("H4_two_keys", "select memory_id from e order by access_count desc, length(text) desc, memory_id limit 25")
def two_keys(spark, d):
    return entries(spark, d).orderBy(F.desc("access_count"), F.desc(F.length("text")), "memory_id").limit(25).select("memory_id")


@query("H5_first", f"select a, b from ({PAIRS}) order by a, b limit 20", entries=False)
def first_pairs(spark, d):
    return graph.similar_pairs(vectors(spark, d), 0.38).orderBy("a", "b").limit(20).select("a", "b")


# Lifecycle.


@query("J11_consolidate", "select memory_id as request_id, case when memory_id % 3 = 0 then 'too_few' when memory_id % 3 = 1 then 'unknown' else 'ok' end as reason from e where memory_id % 20 < 3 and memory_id < (select max(memory_id) - 20 from e)")
def consolidate(spark, d):
    e = entries(spark, d)
    i = F.col("memory_id")
    last = e.agg((F.max("memory_id") - 20).alias("m"))
    ids = F.when(i % 3 == 0, F.array(i, i)).when(i % 3 == 1, F.array(i, F.lit(-5).cast("bigint"))).otherwise(F.array(i, i + 1))
    req = e.filter("memory_id % 20 < 3").crossJoin(F.broadcast(last)).filter("memory_id < m").select(i.alias("request_id"), ids.alias("ids"), F.lit("A conclusion that holds for both!").alias("conclusion"))  # one row
    return C.consolidate(e, req)[1]


# Composite queries.


@query("L6_get", "select memory_id, text, source from e where memory_id = 42")
def get(spark, d):
    return entries(spark, d).filter("memory_id = 42").select("memory_id", "text", "source")


@query("L7_lookup", "select min(memory_id) as memory_id, arg_min(state_value, memory_id) as state_value from e where nullif(lower(trim(state_key)), '') = 'user.k7' and superseded_by is null")
def lookup(spark, d):
    return entries(spark, d).filter((T.state_key(F.col("state_key")) == "user.k7") & F.col("superseded_by").isNull()).agg(F.min("memory_id").alias("memory_id"), F.min_by("state_value", "memory_id").alias("state_value"))


@query("L11_conflicts", CONFLICTS + " select a, b, round(sim, 5) as sim from cp order by ts desc, a, rank limit 50")
def conflicts(spark, d):
    """The first 50 conflicts of active entries, newest first."""
    live, _, pairs = live_pairs(spark, d)
    return graph.conflicts(pairs, live).orderBy(F.desc("ts"), "a", "rank").limit(50).select("a", "b", F.round("sim", 5).alias("sim"))


@query("L13_wiki", ", live as (select * from e where superseded_by is null), st as (select 'state' as part, memory_id from live where state_key is not null), tp as (select lang, count(*) as n from live group by lang order by n desc, lang limit 6), g as (select 'topic' as part, memory_id from (select memory_id, row_number() over (partition by lang order by access_count desc, ts desc, memory_id) as r from live where lang in (select lang from tp)) where r <= 6), u as (select 'used' as part, memory_id from live order by access_count desc, ts desc, memory_id limit 6) select * from st union all select * from g union all select * from u")
def wiki(spark, d):
    live = entries(spark, d).filter("superseded_by is null")
    part = lambda df, name: df.select(F.lit(name).alias("part"), "memory_id")
    used = live.orderBy(F.desc("access_count"), F.desc("ts"), "memory_id").limit(6)
    return part(live.filter("state_key is not null"), "state").unionByName(part(lifecycle.digest(live, 6, 6), "topic")).unionByName(part(used, "used"))


@query("L15_wide", f"{HYBRID}, k as (select query_id, memory_id, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id) where superseded_by is null) select query_id, memory_id from k where rank <= 30")
def wide(spark, d):
    h, v, q, qv = hybrid(spark, d)
    return recall.recall(h, v, q, qv, 30).select("query_id", "memory_id")


@query("L18_pool", f"with t as (select a.label as grp, b.vec_id as memory_id, {COS} as sim, row_number() over (partition by a.vec_id order by {COS} desc, b.vec_id) as r from embeddings a, embeddings b where a.vec_id % 50 = 0) select grp, memory_id, round(max(sim), 5) as sim from t where r <= 10 group by 1, 2", entries=False)
def pooled(spark, d):
    v = vectors(spark, d)
    label = v.filter("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), F.col("label").alias("grp"))
    return V.nearest(v, query_vectors(spark, d), 10).join(label, "query_id").groupBy("grp", "memory_id").agg(F.round(F.max("sim"), 5).alias("sim"))


@query("L19_expansion", f"with t as ({BEST}) select query_id, memory_id from t where r <= 5 or (r <= 10 and memory_id % 2 = query_id % 2)", entries=False)
def expansion(spark, d):
    s = V.nearest(vectors(spark, d), query_vectors(spark, d), 10)
    return s.filter((F.col("rank") < 5) | (F.col("memory_id") % 2 == F.col("query_id") % 2)).select("query_id", "memory_id")


@query("L24_history", ", r as (select memory_id as root, memory_id, 0 as depth from e where memory_id % 17 = 3 union all select r.root, e.superseded_by, depth + 1 from r join e on e.memory_id = r.memory_id and e.superseded_by is not null) select root, memory_id, depth::integer as depth from r where depth > 0")
def history(spark, d):
    a = graph.ancestry(entries(spark, d).select("memory_id", "superseded_by")).filter("memory_id % 17 = 3")
    return a.select(F.col("memory_id").alias("root"), F.col("successor").alias("memory_id"), "depth")


@query("L25_eviction", f"with gone as (select memory_id from (select doc_id as memory_id, {1_700_000_000} - doc_id * 1800 + (doc_id % 7) * 86400 as la from documents order by la, memory_id limit 100)), t as ({BEST}) select query_id, round(avg(case when memory_id in (select memory_id from gone) then 0 else 1 end), 6)::double as kept from t where r <= 5 group by query_id", entries=False)
def eviction_outcome(spark, d):
    gone = eviction(spark, d).withColumn("_x", F.lit(0))
    s = V.nearest(vectors(spark, d), query_vectors(spark, d), 5).join(gone, "memory_id", "left")
    return s.groupBy("query_id").agg(F.round(F.avg(F.coalesce("_x", F.lit(1))), 6).alias("kept"))


@query("L26_rehearsal", f"select round(avg({DW}) filter (access_count >= 5), 6) as hot, round(avg({DW}) filter (access_count < 5), 6) as cold, count(*) filter ({DW} < 0.5) as abandoned from e")
def rehearsal(spark, d):
    w, hot = lifecycle.decay(NOW, TAU), F.col("access_count") >= 5
    return entries(spark, d).agg(F.round(F.avg(F.when(hot, w)), 6).alias("hot"), F.round(F.avg(F.when(~hot, w)), 6).alias("cold"), F.count_if(w < 0.5).alias("abandoned"))
