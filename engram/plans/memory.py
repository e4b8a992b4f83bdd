"""Lexical search, recall, lifecycle, set, ranking, metric and stream queries (groups E to M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import graph, ingest, lexical, lifecycle, metrics, packing, recall
from ..sources import store
from ..sources.entries import NOW, entries, query_vectors, table, vectors
from ..streaming import capture
from .base import query
from .scalar import TOKENS
from .vectors import COS, near_codes

TAU = 30 * 86400.0
DW = f"least(pow(1 + ({NOW} - last_accessed) / case when source = 'model' then {2 * TAU} else {TAU} end, -0.5) * (1 + 0.5 * log2(1 + access_count)), 1.0)"
#: Queries of the lexical side: the text of each entry whose id is divisible by 50.
ASKED = f"p as (select memory_id, unnest({TOKENS}) as token from e), df as (select token, count(*) as df from p group by token), q as (select memory_id as query_id, unnest({TOKENS}) as token from e where memory_id % 50 = 0), n as (select count(*) as n from e), w as (select query_id, q.token, df, ln(1 + n / coalesce(df, 1)) as idf from q left join df using (token), n), a as (select query_id, sum(idf) as all_idf from w group by query_id), lex as (select query_id, memory_id, sum(idf) / any_value(all_idf) as score, sum(idf) as raw from w join p using (token) join a using (query_id) group by query_id, memory_id)"


def asked(e):
    return e.filter("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "text")


@query("F1_frequencies", f", p as (select memory_id, unnest({TOKENS}) as token from e) select token, count(*) as df from p group by token")
def frequencies(spark, d):
    return lexical.frequencies(entries(spark, d))


@query("F2_idf", f", p as (select memory_id, unnest({TOKENS}) as token from e) select token, round(ln(1 + (select count(*) from e) / count(*)), 6) as idf from p group by token")
def idf(spark, d):
    e = entries(spark, d)
    return lexical.frequencies(e).crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("n")))).select("token", F.round(F.log(1 + F.col("n") / F.col("df")), 6).alias("idf"))  # one row


@query("F3_lexical", f", {ASKED} select query_id, memory_id, round(score, 6) as score from lex")
def lexical_ratio(spark, d):
    e = entries(spark, d)
    return lexical.scores(e, asked(e), digits=6)


@query("F4_idf_sum", f", {ASKED} select query_id, memory_id, round(raw, 6) as score from lex")
def idf_sum(spark, d):
    e = entries(spark, d)
    return lexical.scores(e, asked(e), "sum", digits=6)


@query("E2_postings", f", p as (select memory_id, unnest({TOKENS}) as token from e), q as (select memory_id as query_id, unnest({TOKENS}) as token from e where memory_id % 50 = 0) select query_id, count(*) as matches from q join p using (token) group by query_id")
def postings(spark, d):
    e = entries(spark, d)
    return lexical.matches(e, asked(e))


#: Both lists over the shared ids, fused; dense ties by id, lexical ties by the score at nine digits, then id.
RECALL = f"""{ASKED.replace('from e)', 'from h)').replace('from e where', 'from h where').replace('from e),', 'from h),')},
d as (select query_id, memory_id, sim, row_number() over (partition by query_id order by sim desc, memory_id) - 1 as dr from (select a.vec_id as query_id, b.vec_id as memory_id, {COS} as sim from embeddings a, embeddings b where a.vec_id % 50 = 0)),
l as (select query_id, memory_id, score, row_number() over (partition by query_id order by round(score, 9) desc, memory_id) - 1 as lr from lex where score > 0),
f as (select coalesce(d.query_id, l.query_id) as query_id, coalesce(d.memory_id, l.memory_id) as memory_id, dr, lr, coalesce(1.0 / (60 + dr), 0) + coalesce(1.0 / (60 + lr), 0) as rrf from (select * from d where dr < 200) d full join (select * from l where lr < 200) l on d.query_id = l.query_id and d.memory_id = l.memory_id),
fr as (select *, row_number() over (partition by query_id order by round(rrf::double, 12) desc, dr nulls last, lr nulls last) as fused_rank from f)"""
HYBRID = f", h as (select e.* from e join embeddings v on v.vec_id = e.memory_id), {RECALL}"


def hybrid(spark, d):
    v = vectors(spark, d)
    h = entries(spark, d).join(v.select("memory_id"), "memory_id", "left_semi")
    return h, v, asked(h), query_vectors(spark, d)


@query("L1_recall", f"{HYBRID}, k as (select query_id, memory_id, round(rrf::double, 6) as rrf, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id) where superseded_by is null) select * from k where rank <= 5")
def recall_query(spark, d):
    h, v, q, qv = hybrid(spark, d)
    return recall.recall(h, v, q, qv).select("query_id", "memory_id", F.round("rrf", 6).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@query("D2_recall_compartment", f"{HYBRID}, k as (select query_id, memory_id, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id) where superseded_by is null and lang = 'fr') select * from k where rank <= 5")
def recall_compartment(spark, d):
    h, v, q, qv = hybrid(spark, d)
    return recall.recall(h, v, q, qv, compartment="fr").select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@query("E3_fused", f"{HYBRID} select query_id, memory_id, round(rrf::double, 6) as rrf, fused_rank from fr where fused_rank <= 20")
def fused(spark, d):
    h, v, q, qv = hybrid(spark, d)
    return recall.fuse(recall.dense_list(v, qv), recall.lexical_list(h, q)).filter("fused_rank <= 20").select("query_id", "memory_id", F.round("rrf", 6).alias("rrf"), F.col("fused_rank").cast("long").alias("fused_rank"))


@query("L4_recall_index", f"{HYBRID}, k as (select query_id, memory_id, left(text, 50) as line, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id)) select query_id, memory_id, line from k where rank <= 10")
def recall_index(spark, d):
    h, v, q, qv = hybrid(spark, d)
    return recall.recall(h, v, q, qv, 10, superseded=True).join(h.select("memory_id", "text"), "memory_id").select("query_id", "memory_id", F.left("text", F.lit(50)).alias("line"))


@query("L14_time_scoped", f"{HYBRID}, k as (select query_id, memory_id, fused_rank, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id) where superseded_by is null), s as (select query_id, memory_id, row_number() over (partition by query_id order by rank) as rank from k join h using (memory_id) where k.rank <= 20 and ts >= {NOW} - 15 * 86400) select query_id, memory_id, rank from s where rank <= 5")
def time_scoped(spark, d):
    h, v, q, qv = hybrid(spark, d)
    wide = recall.recall(h, v, q, qv, 20).filter(F.col("ts") >= NOW - 15 * 86400)
    return recall.top(wide.drop("fused_rank").withColumnRenamed("rank", "wide"), [F.col("wide")], 5, ["query_id"]).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@query("L21_effective", f"{HYBRID}, k as (select query_id, memory_id, {DW} * case source when 'model' then 1.15 when 'import' then 1.15 when 'hook' then 0.9 else 1.0 end * (coalesce(d.sim, 0) + 0.25 * coalesce(l.score, 0)) as eff from fr left join d using (query_id, memory_id) left join l using (query_id, memory_id) join h using (memory_id) where fused_rank <= 10) select query_id, memory_id, round(eff::double, 5) as eff from k")
def effective(spark, d):
    h, v, q, qv = hybrid(spark, d)
    top = graph.checkpointed(recall.fuse(recall.dense_list(v, qv), recall.lexical_list(h, q)).filter("fused_rank <= 10").select("query_id", "memory_id"))
    found = top.join(v.select("memory_id", "embedding"), "memory_id").join(qv.withColumnRenamed("embedding", "qe"), "query_id")  # a row may be in one list only: both scores are taken anew
    found = found.join(lexical.pair_scores(h, q, top), ["query_id", "memory_id"], "left").join(h.select("memory_id", (lifecycle.decay(NOW, TAU) * T.source_weight(F.col("source"))).alias("w")), "memory_id")
    sim = V.cosine(F.col("embedding"), F.col("qe"))
    return found.select("query_id", "memory_id", F.round(F.col("w") * (sim + 0.25 * F.coalesce("score", F.lit(0.0))), 5).alias("eff"))


@query("L2_two_stage")
def two_stage(spark, d):
    """Sign-code candidates first, then cosine among them."""
    near = near_codes(spark, d, 100).select("query_id", "memory_id")
    v, qv = vectors(spark, d), query_vectors(spark, d).withColumnRenamed("embedding", "qe")
    scored = near.join(v, "memory_id").join(qv, "query_id").select("query_id", "memory_id", V.cosine(F.col("embedding"), F.col("qe")).alias("sim"))
    return recall.top(scored, [F.desc("sim"), F.col("memory_id")], 5, ["query_id"])


@query("J12_touch", f"{HYBRID}, k as (select query_id, memory_id, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id) where superseded_by is null), t as (select memory_id, count(*) as n from k where rank <= 5 group by memory_id) select memory_id, access_count + coalesce(n, 0) as access_count from h left join t using (memory_id)")
def touch(spark, d):
    h, v, q, qv = hybrid(spark, d)
    return recall.touched(h, recall.recall(h, v, q, qv), NOW).select("memory_id", "access_count")


@query("L5_recall_block", f"{HYBRID}, k as (select query_id, memory_id, text, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id) where superseded_by is null), s as (select query_id, rank, length('[#' || memory_id || ']') + 1 + least(length(trim(text)), 600) + 2 as size from k where rank <= 12), pack as (select query_id, 0::bigint as rank, 0::bigint as used, 0 as taken from (select distinct query_id from s) union all select s.query_id, s.rank, case when used + size <= 3000 then used + size else used end, case when used + size <= 3000 then taken + 1 else taken end from pack join s on s.query_id = pack.query_id and s.rank = pack.rank + 1) select query_id, max(taken)::integer as taken, max(used)::integer as used from pack group by query_id")
def recall_block(spark, d):
    h, v, q, qv = hybrid(spark, d)
    hits = recall.recall(h, v, q, qv, 12).join(h.select("memory_id", "text"), "memory_id")
    item = F.struct("rank", "memory_id", F.concat(F.lit("[#"), F.col("memory_id").cast("string"), F.lit("]")).alias("label"), "text")
    return hits.groupBy("query_id").agg(F.collect_list(item).alias("i")).select("query_id", packing.packed(F.col("i"), 3000).alias("p")).select("query_id", "p.taken", "p.used")


# Lifecycle.


@query("G4_closed", ", k as (select memory_id, nullif(lower(trim(state_key)), '') as key, ts from e) select memory_id, case when key is not null then lead(memory_id) over (partition by key order by memory_id) end as next_id, case when key is not null then lead(ts) over (partition by key order by memory_id) end as next_ts from k")
def closed(spark, d):
    e = entries(spark, d).withColumn("key", T.state_key(F.col("state_key")))
    keyed = lifecycle.close_keyed(e.filter("key is not null")).select("memory_id", "next_id", "next_ts")
    return keyed.unionByName(e.filter("key is null").selectExpr("memory_id", "cast(null as bigint) next_id", "cast(null as double) next_ts"))  # unkeyed rows never meet in one task


@query("G5_state_history", "select memory_id, state_value, coalesce(valid_from, ts) as since from e where nullif(lower(trim(state_key)), '') = 'user.k7'")
def state_history(spark, d):
    return entries(spark, d).filter(T.state_key(F.col("state_key")) == "user.k7").select("memory_id", "state_value", F.coalesce("valid_from", "ts").alias("since")).orderBy("since")


@query("G6_state_current", "select nullif(lower(trim(state_key)), '') as key, min(memory_id) as memory_id from e where state_key is not null and superseded_by is null group by 1")
def state_current(spark, d):
    return entries(spark, d).filter("superseded_by is null and state_key is not null").groupBy(T.state_key(F.col("state_key")).alias("key")).agg(F.min("memory_id").alias("memory_id"))


@query("J5_supersede")
def supersede(spark, d):
    e = entries(spark, d)
    req = e.filter("memory_id % 31 = 0").select(F.col("memory_id").alias("old_id"), (F.col("memory_id") + F.when(F.col("memory_id") % 62 == 0, 0).otherwise(5)).alias("new_id"))
    return lifecycle.supersede(e, req, NOW)[1]


@query("J6_organize", r", live as (select *, nullif(lower(trim(state_key)), '') as key, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as norm from e where superseded_by is null), a as (select memory_id, first_value(memory_id) over (partition by key order by ts desc, memory_id desc) as keeper, 'stale_key' as reason from live where key is not null), b as (select memory_id, first_value(memory_id) over (partition by norm order by ts desc, memory_id desc) as keeper, 'exact_repeat' as reason from live) select * from (select * from a union all select * from b) where memory_id <> keeper")
def organize(spark, d):
    return lifecycle.organize(entries(spark, d))


@query("J7_vacuum", f"select memory_id from e where not (superseded_by is not null and coalesce(valid_to, ts) < {NOW} - 20 * 86400)")
def vacuum(spark, d):
    return lifecycle.vacuum(entries(spark, d), NOW, 20).select("memory_id")


EV = ", v as (select *, case when memory_id % 10 = 1 then [memory_id - 1, memory_id + 3] else []::bigint[] end as evidence_ids from e)"


@query("J8_cleanup", f"{EV}, m as (select *, {DW} >= case when source in ('model', 'import') then 0.9 / 3 else 0.9 end as stays from v), g as (select list(memory_id) as gone from m where not stays) select memory_id, len(list_filter(evidence_ids, lambda x: not list_contains(gone, x)))::integer as evidence from m, g where stays")
def cleanup(spark, d):
    return lifecycle.decay_cleanup(entries(spark, d), NOW, TAU, 0.9, protect=True).select("memory_id", F.size("evidence_ids").alias("evidence"))


@query("J9_forget", f"{EV} select memory_id, len(list_filter(evidence_ids, lambda x: x % 40 <> 0))::integer as evidence from v where memory_id % 40 <> 0")
def forget(spark, d):
    e = entries(spark, d)
    return lifecycle.forget(e, e.filter("memory_id % 40 = 0").select("memory_id")).select("memory_id", F.size("evidence_ids").alias("evidence"))


@query("J10_redacted")
def redacted(spark, d):
    return lifecycle.redact(entries(spark, d), NOW).filter("hits > 0").select("memory_id", "hits", "tags")


@query("J13_stamp", "select memory_id, case when app = 'src1' then 'app:src1' else 'app:' || app || ',app:src1' end as apps from e")
def stamp(spark, d):
    tags = lifecycle.stamp_app(F.col("tags"), "src1")
    return entries(spark, d).select("memory_id", F.array_join(F.filter(tags, lambda t: t.startswith("app:")), ",").alias("apps"))


@query("J14_migrated", ", k as (select *, nullif(lower(trim(state_key)), '') as key from e), b as (select key, max(ts) as best_ts, arg_max(memory_id, ts) as best from k where superseded_by is null and key is not null group by key) select memory_id, case when b.key is not null and superseded_by is null and memory_id <> best then best else superseded_by end as superseded_by from k left join b using (key)")
def migrated(spark, d):
    e = entries(spark, d)
    keyed = lifecycle.migrate_keys(e.filter("state_key is not null"))
    return keyed.unionByName(e.filter("state_key is null")).select("memory_id", "superseded_by")


@query("J2_remember")
def remember(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").alias("seq"), "text", F.lit("hook").alias("source"), F.col("turn").cast("double").alias("ts"))
    return ingest.remember(c)


@query("J2_rollup")
def rollup(spark, d):
    return ingest.rolled_up(remember(spark, d))


@query("E6_evidence", f"{EV} select x as memory_id, count(*) as cited_by from (select unnest(evidence_ids) as x from v) group by x")
def evidence(spark, d):
    return entries(spark, d).select(F.explode("evidence_ids").alias("memory_id")).groupBy("memory_id").agg(F.count(F.lit(1)).alias("cited_by"))


@query("E7_lineage", ", r as (select memory_id, superseded_by as successor, 1 as depth from e where superseded_by is not null union all select r.memory_id, e.superseded_by, r.depth + 1 from r join e on r.successor = e.memory_id and e.superseded_by is not null) select memory_id, successor, depth::integer as depth from r")
def lineage(spark, d):
    return graph.ancestry(entries(spark, d).select("memory_id", "superseded_by"))


@query("E10_not_recalled", f", r as (select memory_id from e where ts >= {NOW} - 12 * 86400 and superseded_by is null) select memory_id from r where memory_id % 50 <> 0")
def not_recalled(spark, d):
    e = entries(spark, d)
    trail = e.filter((F.col("ts") >= NOW - 12 * 86400) & F.col("superseded_by").isNull())
    return trail.join(e.filter("memory_id % 50 = 0"), "memory_id", "left_anti").select("memory_id")


@query("E11_capture_batches", ", b as (select app, cast(floor(ts / 86400) as bigint) as bucket, count(*) as n, min(memory_id) as first from e group by 1, 2) select app, bucket, n, first from b where n >= 2")
def batches(spark, d):
    return entries(spark, d).groupBy("app", F.floor(F.col("ts") / 86400).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("memory_id").alias("first")).filter("n >= 2")


@query("E16_as_of", "select memory_id from e where valid_from <= 1699900000 and (valid_to is null or valid_to > 1699900000)")
def as_of(spark, d):
    return lifecycle.as_of(entries(spark, d), 1_699_900_000.0).select("memory_id")


@query("E9_semi", "select e.memory_id from e where memory_id in (select doc_id from labels where quality = 1)")
def semi(spark, d):
    return entries(spark, d).join(table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("memory_id")), "memory_id", "left_semi").select("memory_id")


# Aggregates, ranks, sets.


@query("F6_stats", f"select count(*) as n, min({NOW} - ts) as newest_age, max({NOW} - ts) as oldest_age, round(avg(access_count), 6) as access, round(avg({DW}), 6) as weight from e")
def stats(spark, d):
    return entries(spark, d).agg(F.count(F.lit(1)).alias("n"), F.min(NOW - F.col("ts")).alias("newest_age"), F.max(NOW - F.col("ts")).alias("oldest_age"), F.round(F.avg("access_count"), 6).alias("access"), F.round(F.avg(lifecycle.decay(NOW, TAU)), 6).alias("weight"))


@query("F6_top_apps", "select app, count(*) as n from e group by app order by n desc, app limit 8")
def top_apps(spark, d):
    return entries(spark, d).groupBy("app").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "app").limit(8)


@query("F7_counts", "select count(*) as total, count(*) filter (superseded_by is null) as active, count(*) filter (superseded_by is not null) as superseded, count(*) filter (state_key is not null) as keyed, count(*) filter (memory_id % 10 = 1) as with_evidence from e")
def counts(spark, d):
    return entries(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("superseded_by").isNull()).alias("active"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.count_if(F.col("state_key").isNotNull()).alias("keyed"), F.count_if(F.size("evidence_ids") > 0).alias("with_evidence"))


@query("F8_digest", ", live as (select * from e where superseded_by is null), s as (select lang, count(*) as total from live group by lang order by total desc, lang limit 8), r as (select lang as bucket, memory_id, access_count as uses, left(text, 140) as text, row_number() over (partition by lang order by access_count desc, ts desc, memory_id) as rank from live) select bucket, total, rank::integer as rank, memory_id, uses, text from r join s on s.lang = r.bucket where rank <= 12")
def digest(spark, d):
    return lifecycle.digest(entries(spark, d))


@query("F9_hit_at_k", ", g as (select doc_id as memory_id from labels where quality = 1), r as (select lang as query_id, memory_id, row_number() over (partition by lang order by access_count desc, memory_id) as rank from e), h as (select query_id, max(case when g.memory_id is not null then 1 else 0 end) as hit from r left join g using (memory_id) where rank <= 3 group by query_id) select count(*) as queries, avg(hit)::double as hit_rate from h")
def hit(spark, d):
    e = entries(spark, d).withColumnRenamed("lang", "query_id")
    ranked = recall.top(e, [F.desc("access_count"), F.col("memory_id")], 3, ["query_id"]).select("query_id", "memory_id", "rank")
    gold = e.join(table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("memory_id")), "memory_id", "left_semi").select("query_id", "memory_id")
    return metrics.hit_at_k(ranked, gold, 3)


@query("F10_mrr", ", g as (select lang as query_id, doc_id as memory_id from labels join e on e.memory_id = doc_id where quality = 1), r as (select lang as query_id, memory_id, row_number() over (partition by lang order by access_count desc, memory_id) as rank from e), f as (select query_id, count(*) as n, min(rank) as first from r join g using (query_id, memory_id) where rank <= 5 group by query_id) select query_id, round(coalesce(n, 0) / n_gold, 6)::double as recall, round(coalesce(1.0 / first, 0), 6)::double as rr from (select query_id, count(*) as n_gold from g group by query_id) left join f using (query_id)")
def mrr(spark, d):
    e = entries(spark, d).withColumnRenamed("lang", "query_id")
    ranked = recall.top(e, [F.desc("access_count"), F.col("memory_id")], 5, ["query_id"]).select("query_id", "memory_id", "rank")
    gold = e.join(table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("memory_id")), "memory_id", "left_semi").select("query_id", "memory_id")
    m = metrics.recall_and_mrr(ranked, gold, 5)
    return m.select("query_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


@query("F14_prf", ", p as (select (quality = 0) as gold, len(text) < 700 as predicted from labels join e on e.memory_id = doc_id), c as (select count(*) filter (predicted and gold) as tp, count(*) filter (predicted and not gold) as fp, count(*) filter (not predicted and gold) as fn from p) select tp, fp, fn, round(tp / nullif(tp + fp, 0), 6)::double as precision, round(tp / nullif(tp + fn, 0), 6)::double as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6)::double as f1 from c")
def prf(spark, d):
    p = table(spark, d, "labels").join(entries(spark, d).withColumnRenamed("memory_id", "doc_id"), "doc_id").select((F.col("quality") == 0).alias("gold"), (F.length("text") < 700).alias("predicted"))
    return metrics.precision_recall(p).select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("F16_weighted", "select sum(quality)::bigint as correct, sum(toxic)::bigint as part, round((sum(quality) + 0.5 * sum(toxic)) / count(*), 6)::double as score from labels", entries=False)
def weighted(spark, d):
    return table(spark, d, "labels").agg(F.sum("quality").alias("correct"), F.sum("toxic").alias("part"), F.round((F.sum("quality") + 0.5 * F.sum("toxic")) / F.count(F.lit(1)), 6).alias("score"))


@query("F17_discordant", "select quality = 1 as a, toxic = 1 as b, count(*) as n from labels group by 1, 2", entries=False)
def discordant(spark, d):
    return table(spark, d, "labels").groupBy((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("F18_gini", ", r as (select access_count::double as v, row_number() over (order by access_count) as i, count(*) over () as n from e) select round(2 * sum(i * v) / (max(n) * sum(v)) - (max(n) + 1) / max(n), 6)::double as gini from r")
def gini(spark, d):
    return metrics.gini(entries(spark, d), "access_count").select(F.round("gini", 6).alias("gini"))


@query("F19_retention", f"select source, round(avg(case when access_count >= 5 then {DW} end), 6) as hot, round(avg(case when access_count = 0 then {DW} end), 6) as idle from e group by source")
def retention(spark, d):
    w = lifecycle.decay(NOW, TAU)
    return entries(spark, d).groupBy("source").agg(F.round(F.avg(F.when(F.col("access_count") >= 5, w)), 6).alias("hot"), F.round(F.avg(F.when(F.col("access_count") == 0, w)), 6).alias("idle"))


@query("F25_vote", "with v as (select user_id, event_type, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as r, sum(n) over (partition by user_id) as t from v) select user_id, event_type as winner, round(n / t, 6)::double as agreement from r where r = 1", entries=False)
def vote(spark, d):
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "event_type")).alias("m"), F.sum("n").alias("t")).select("user_id", F.col("m.event_type").alias("winner"), F.round(-F.col("m.k") / F.col("t"), 6).alias("agreement"))


@query("F28_ledger", "select user_id, count(*) as n from events where event_type = (select min(event_type) from events) group by user_id", entries=False)
def ledger(spark, d):
    ev = table(spark, d, "events")
    return ev.join(F.broadcast(ev.agg(F.min("event_type").alias("event_type"))), "event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))  # one row


@query("G7_trail", f"select memory_id, ts from e where ts >= {NOW} - 14 * 86400 and superseded_by is null order by ts desc, memory_id limit 12")
def trail(spark, d):
    return entries(spark, d).filter((F.col("ts") >= NOW - 14 * 86400) & F.col("superseded_by").isNull()).orderBy(F.desc("ts"), "memory_id").limit(12).select("memory_id", "ts")


@query("G9_acts", "with a as (select *, case when lag(event_type) over w is distinct from event_type then 1 else 0 end as edge from events window w as (partition by user_id order by ts, event_id)), b as (select *, sum(edge) over (partition by user_id order by ts, event_id) as run from a), c as (select *, (row_number() over (partition by user_id, run order by ts, event_id) - 1) // 6 as part from b) select user_id, run::bigint as run, part::bigint as part, count(*) as n from c group by 1, 2, 3", entries=False)
def acts(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = table(spark, d, "events").withColumn("edge", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("int"))
    b = a.withColumn("run", F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = b.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id")) - 1) / 6))
    return c.groupBy("user_id", "run", "part").agg(F.count(F.lit(1)).alias("n"))


@query("G13_newest_per_text", "select md5(text) as k, max(memory_id) filter (ts = m) as memory_id from (select *, max(ts) over (partition by md5(text)) as m from e) group by 1")
def newest_per_text(spark, d):
    return entries(spark, d).groupBy(F.md5("text").alias("k")).agg(F.max(F.struct("ts", "memory_id")).alias("m")).select("k", "m.memory_id")


@query("G14_eviction", "select memory_id from e order by last_accessed, memory_id limit 100")
def eviction(spark, d):
    return entries(spark, d).orderBy("last_accessed", "memory_id").limit(100).select("memory_id")


@query("G16_fading", f"select memory_id, round({DW}, 6) as weight from e where source in ('model', 'import') and superseded_by is null and {DW} < 0.95 order by round({DW}, 9), memory_id limit 10")
def fading(spark, d):
    w = lifecycle.decay(NOW, TAU)
    return entries(spark, d).filter(F.col("source").isin("model", "import") & F.col("superseded_by").isNull() & (w < 0.95)).withColumn("w", w).orderBy(F.round("w", 9), "memory_id").limit(10).select("memory_id", F.round("w", 6).alias("weight"))


@query("H1_topk", "select memory_id, access_count from e order by access_count desc, memory_id limit 20")
def topk(spark, d):
    return entries(spark, d).orderBy(F.desc("access_count"), "memory_id").limit(20).select("memory_id", "access_count")


@query("SO2_new_tokens", f", t as (select memory_id, {TOKENS} as t from e) select a.memory_id, len(list_filter(a.t, lambda x: not list_contains(b.t, x)))::integer as fresh from t a join t b on b.memory_id = a.memory_id + 1")
def new_tokens(spark, d):
    t = entries(spark, d).select("memory_id", T.tokens(F.col("text")).alias("t"))
    return t.join(t.select((F.col("memory_id") - 1).alias("memory_id"), F.col("t").alias("o")), "memory_id").select("memory_id", F.size(F.array_except("t", "o")).alias("fresh"))


@query("SO3_keep", "select memory_id from e except select memory_id from (select memory_id from e order by last_accessed, memory_id limit 100)")
def keep(spark, d):
    return entries(spark, d).join(eviction(spark, d), "memory_id", "left_anti").select("memory_id")


@query("SO4_both", "select memory_id from e where access_count > 5 intersect select memory_id from e where source = 'model'")
def both(spark, d):
    e = entries(spark, d)
    return e.filter("access_count > 5").select("memory_id").intersect(e.filter("source = 'model'").select("memory_id"))


@query("SO5_or", "select user_id, bit_or(1 << (event_id % 16)::integer)::bigint as seen from events group by user_id", entries=False)
def bits(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bit_or(F.expr("shiftleft(1L, cast(event_id % 16 as int))")).alias("seen"))


@query("SO7_pool", "select user_id, round(max(value), 6) as best from events group by user_id", entries=False)
def pool(spark, d):
    ev = table(spark, d, "events")
    half = ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1")
    return half[0].unionByName(half[1]).groupBy("user_id").agg(F.round(F.max("value"), 6).alias("best"))


@query("L9_session_pack", f", t as (select 'trail' as part, memory_id, ts from e where ts >= {NOW} - 14 * 86400 and superseded_by is null order by ts desc, memory_id limit 12), c as (select 'conclusion' as part, memory_id, ts from e where source = 'model' and superseded_by is null order by ts desc, memory_id limit 5) select part, memory_id from t union all select part, memory_id from c")
def session_pack(spark, d):
    e = entries(spark, d).filter("superseded_by is null")
    c = e.filter("source = 'model'").orderBy(F.desc("ts"), "memory_id").limit(5).select(F.lit("conclusion").alias("part"), "memory_id")
    return trail(spark, d).select(F.lit("trail").alias("part"), "memory_id").unionByName(c)


# Sources, sinks, streams.


@query("A4_facts")
def facts(spark, d):
    return store.export_facts(store.conform(entries(spark, d)))


@query("A2_legacy", "select memory_id, ts as last_accessed, 'auto' as source, 0::bigint as access_count from e")
def legacy(spark, d):
    return store.conform(entries(spark, d).select("memory_id", "text", "ts")).select("memory_id", "last_accessed", "source", "access_count")


@query("M2_tumbling", "select time_bucket(interval 1 hour, ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2", entries=False)
def tumbling(spark, d):
    return capture.tumbling(table(spark, d, "events"), late=None).withColumn("total", F.round("total", 4))


@query("M3_sliding", "select time_bucket(interval 1 hour, ts)::timestamp - to_hours(k::integer) as start, event_type, count(*) as n from events, range(3) r(k) group by 1, 2", entries=False)
def sliding(spark, d):
    return capture.sliding(table(spark, d, "events"))


@query("M4_sessions", "with a as (select *, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as edge from events window w as (partition by user_id order by ts)), b as (select *, sum(edge) over (partition by user_id order by ts rows unbounded preceding) as s from a) select user_id, min(ts)::timestamp as start, (max(ts) + interval 30 minutes)::timestamp as \"end\", count(*) as n from b group by user_id, s", entries=False)
def sessions(spark, d):
    return capture.sessions(table(spark, d, "events"))


@query("M8_gate")
def gate(spark, d):
    return capture.gated(table(spark, d, "conversations")).select("conv_id", "turn")


@query("K5_dependents", f"{EV} select x as memory_id, list_sort(list(memory_id)) as dependents from (select memory_id, unnest(evidence_ids) as x from v) group by x")
def dependents(spark, d):
    return entries(spark, d).select("memory_id", F.explode("evidence_ids").alias("x")).groupBy(F.col("x").alias("memory_id")).agg(F.array_sort(F.collect_list(F.col("memory_id"))).alias("dependents"))


@query("K4_resolve")
def resolve(spark, d):
    v = vectors(spark, d)
    hits = V.nearest(v, query_vectors(spark, d), 10).filter("query_id <> memory_id").drop("rank")
    return graph.pool_resolve(hits, graph.clusters(v, 0.38), entries(spark, d))
