"""Legacy encoders and gates, tree routes, reranking, judged cases and further single-operator queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lenient
from ..functions import text as T
from ..functions import vector as V
from ..operators import cases, graph, hopfield, ingest, lifecycle, metrics, recall, tree
from ..sources import store
from ..sources.entries import NOW, entries, query_vectors, table, vectors
from .base import query
from .memory import DW, HYBRID, TAU, hybrid
from .more import patterns
from .scalar import TOKENS
from .vectors import BEST, COS, PAIRS

HASHED = "list_sort(list_distinct(flatten(list_transform({t}, lambda w: [('0x' || substr(md5(w), 1, 2))::integer, ('0x' || substr(md5(w), 9, 2))::integer, ('0x' || substr(md5(w), 17, 2))::integer]))))"


def embedded(df, *ids):
    """The set dimensions of each text's offline embedding."""
    e = lenient.embed(F.array_sort(T.tokens(F.coalesce("text", F.lit("")))))
    return df.select(*ids, e.alias("e")).select(*ids, F.transform(F.filter(F.transform("e", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()), lambda i: i).alias("dims"))


@query("A8_bulk", f"select conv_id, turn, {HASHED.format(t=TOKENS.replace('(text)', '''(coalesce(text, ''))'''))} as dims from conversations", entries=False)
def bulk(spark, d):
    """Bulk load without dedup: every turn encoded in Arrow batches."""
    return embedded(table(spark, d, "conversations"), "conv_id", "turn")


@query("A12_dialogues", "select conv_id as id, row_number() over (partition by conv_id order by turn) - 1 as pos, role as speaker, md5(text) as text from conversations", entries=False)
def dialogues(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))), lambda x: F.struct(x.speaker.alias("speaker"), x.text.alias("text")))
    raw = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.to_json(F.struct(F.create_map(F.lit("session_1"), turns).alias("conversation"))).alias("json"))
    return store.dialogues(raw).select("id", F.col("pos").cast("long").alias("pos"), "speaker", F.md5("text").alias("text"))


@query("A13_pinned", "select memory_id, access_count from e")
def pinned(spark, d):
    """A version stays readable by its name after the pointer has moved on."""
    graph.checkpointed(spark.range(1))
    lib = store.Library(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/library-{uuid.uuid4().hex}")
    first, _ = lib.save(entries(spark, d))
    lib.save(entries(spark, d).withColumn("access_count", F.lit(0)), base=first)
    return lib.load(first).select("memory_id", "access_count")


@query("C1_embed", f"select memory_id, {HASHED.format(t=TOKENS.replace('(text)', '''(coalesce(text, ''))'''))} as dims from e")
def embed(spark, d):
    return embedded(entries(spark, d), "memory_id")


# Codes.


def ones(code):
    return F.aggregate(code, F.lit(0), lambda s, x: s + F.bit_count(x))


@query("C5_sparse_code", "select vec_id as memory_id, 204 as ones from embeddings", entries=False)
def sparse_code(spark, d):
    """5 % of 4096 bits."""
    return vectors(spark, d).select("memory_id", ones(V.projected_code("embedding", 64, keep=0.05)).alias("ones"))


def projected(spark, d):
    return vectors(spark, d).select("memory_id", "label", V.projected_code("embedding", 64).alias("code"))


@query("C6_prefilter")
def prefilter(spark, d):
    """Share of the 100 nearest by cosine among the 250 nearest by projected code."""
    coded = projected(spark, d)
    near = V.nearest_codes(coded, coded.filter("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id"), 250)
    return metrics.overlap(V.nearest(vectors(spark, d), query_vectors(spark, d), 100), near)


@query("C7_united")
def united(spark, d):
    """Bits set in the union of all codes, per label."""
    return V.united(projected(spark, d), "label").select("label", ones(F.col("code")).alias("ones"))


def placed(spark, d):
    return patterns(spark, d).withColumn("compartment", F.pmod(F.xxhash64("code"), F.lit(8)))


@query("C14_recall_all")
def recall_all(spark, d):
    p = placed(spark, d)
    return hopfield.recall_all(p, p.filter("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id"))


@query("L23_completed")
def completed(spark, d):
    """The pattern that each settled cue overlaps most, over the whole store."""
    p = patterns(spark, d)
    return hopfield.best_match(p, hopfield.settle(p, p.filter("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id"))).drop("compartment")


def messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").alias("seq"), "text")


@query("C16_novelty")
def novelty(spark, d):
    return ingest.novelty_gate(messages(spark, d))


@query("C17_code_novelty")
def code_novelty(spark, d):
    return ingest.novelty_gate(messages(spark, d), 0.3, codes=True)


@query("J15_unique_codes", f", c as (select memory_id, {HASHED.format(t=TOKENS.replace('(text)', '''(coalesce(text, ''))'''))}::varchar as code from e) select memory_id, memory_id = min(memory_id) over (partition by code) as is_new from c")
def unique_codes(spark, d):
    """Every write takes an id; a code is stored once, by its first write. The minimum is found by partial aggregation."""
    code = lenient.embed_bits(F.array_sort(T.tokens(F.coalesce("text", F.lit("")))))
    c = graph.checkpointed(entries(spark, d).select("memory_id", code.alias("code")))  # codes are made once, for both sides
    return c.groupBy("code").agg(F.min("memory_id").alias("first")).join(c, "code").select("memory_id", (F.col("memory_id") == F.col("first")).alias("is_new"))


# Filters, joins, ranks.


@query("D5_months", f"{HYBRID}, k as (select query_id, memory_id, ts, row_number() over (partition by query_id order by fused_rank) as wide from fr join h using (memory_id) where superseded_by is null), s as (select query_id, memory_id, row_number() over (partition by query_id order by wide) as rank from k where wide <= 20 and ts >= epoch(timestamp '2023-11-01') and ts < epoch(timestamp '2023-11-01') + 31 * 86400) select * from s where rank <= 5")
def months(spark, d):
    h, v, q, qv = hybrid(spark, d)
    start, end = recall.months("2023-11", "2023-11")
    wide = recall.recall(h, v, q, qv, 20).filter((F.col("ts") >= start) & (F.col("ts") < end)).select("query_id", "memory_id", F.col("rank").alias("wide"))
    return recall.top(wide, [F.col("wide")], 5, ["query_id"]).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@query("D6_floors", f"select f as floor, count(a) as pairs from (values (0.38), (0.45), (0.6)) t(f) left join ({PAIRS}) on sim >= f group by f".replace("(0.38), (0.45), (0.6)", "(0.38::double), (0.45::double), (0.6::double)"), entries=False)
def floors(spark, d):
    p = graph.similar_pairs(vectors(spark, d), 0.38)
    return p.agg(*(F.count_if(F.col("sim") >= f).alias(str(i)) for i, f in enumerate((0.38, 0.45, 0.6)))).select(F.explode(F.array(*(F.struct(F.lit(f).alias("floor"), F.col(str(i)).alias("pairs")) for i, f in enumerate((0.38, 0.45, 0.6))))).alias("x")).select("x.floor", "x.pairs")


@query("D8_retained", f"select memory_id from e where {DW} >= case when source in ('model', 'import') then 0.9 / 3 else 0.9 end")
def retained(spark, d):
    return lifecycle.decay_cleanup(entries(spark, d), NOW, TAU, 0.9, protect=True).select("memory_id")


CHAINS = ", r as (select memory_id, superseded_by as successor from e where superseded_by is not null union select r.memory_id, e.superseded_by from r join e on r.successor = e.memory_id and e.superseded_by is not null)"


@query("E8_validated", CHAINS + ", q as (select memory_id + 1 as old_id, memory_id as new_id from e) select old_id, new_id, case when o.memory_id is null then 'unknown' when r.memory_id is not null then 'cycle' when n.superseded_by is not null then 'new_superseded' else 'ok' end as reason from q join e n on n.memory_id = new_id left join e o on o.memory_id = old_id left join r on r.memory_id = new_id and r.successor = old_id")
def validated(spark, d):
    """Each entry asked to replace the one after it; chains that lead back are refused."""
    e = entries(spark, d)
    return lifecycle.supersede(e, e.select((F.col("memory_id") + 1).alias("old_id"), F.col("memory_id").alias("new_id")), NOW)[1].select("old_id", "new_id", "reason")


@query("E12_evidence_session", f"select query_id, memory_id, coalesce(a.lang = b.lang or a.source = b.source, false) as met from ({BEST}) t join documents a on a.doc_id = query_id join documents b on b.doc_id = memory_id where r <= 10", entries=False)
def evidence_session(spark, d):
    tags = entries(spark, d).select("memory_id", "tags")
    hits = V.nearest(vectors(spark, d), query_vectors(spark, d), 10).join(tags, "memory_id")
    return hits.join(tags.select(F.col("memory_id").alias("query_id"), F.col("tags").alias("asked")), "query_id").select("query_id", "memory_id", F.coalesce(F.arrays_overlap("tags", "asked"), F.lit(False)).alias("met"))


TREE = """m as (select vec_id as memory_id, label as l1, vec_id % 4 as l2, embedding from embeddings),
c1 as (select l1, list(c order by i) as centre from (select l1, i, avg(embedding[i]::double) as c from m, range(1, 65) t(i) group by l1, i) group by l1),
c2 as (select l1, l2, list(c order by i) as centre from (select l1, l2, i, avg(embedding[i]::double) as c from m, range(1, 65) t(i) group by l1, l2, i) group by l1, l2),
q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0),
s1 as (select query_id, q, l1, row_number() over (partition by query_id order by round(list_dot_product(q, centre), 9) desc, l1) as r1 from q, c1),
s2 as (select query_id, s1.l1, l2, row_number() over (partition by query_id, s1.l1 order by round(list_dot_product(q, centre), 9) desc, l2) as r2 from s1 join c2 on c2.l1 = s1.l1 where r1 <= 2),
found as (select query_id, memory_id from s2 join m on m.l1 = s2.l1 and m.l2 = s2.l2 where r2 <= 2)"""
FOUND_SIM = f"fs as (select f.query_id, f.memory_id, round({COS}, 9) as sim from found f join embeddings a on a.vec_id = f.query_id join embeddings b on b.vec_id = f.memory_id)"


def branches(spark, d):
    return vectors(spark, d).select("memory_id", F.col("label").alias("l1"), (F.col("memory_id") % 4).alias("l2"), "embedding")


def route(spark, d):
    return tree.navigate(branches(spark, d), query_vectors(spark, d))


@query("E15_tree_route", f"with {TREE} select * from found", entries=False)
def tree_route(spark, d):
    return route(spark, d).select("query_id", "memory_id")


@query("L16_tree", f"with {TREE}, {FOUND_SIM} select query_id, memory_id from (select *, row_number() over (partition by query_id order by sim desc, memory_id) as k from fs) where k <= 5", entries=False)
def tree_collector(spark, d):
    m, q = branches(spark, d), query_vectors(spark, d)
    return tree.best(m, tree.leaves(m, q), q, 5).select("query_id", "memory_id")


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda x: regexp_full_match(x, '\p{{L}}+') and not list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], x)))"


@query("L17_needles", f"with {TREE}, {FOUND_SIM}, w as (select query_id, memory_id, sim, len(list_intersect({WORDS.format(t='x.text')}, {WORDS.format(t='y.text')})) as shared from fs join documents x on x.doc_id = query_id join documents y on y.doc_id = memory_id) select query_id, memory_id, shared::integer as shared from (select *, row_number() over (partition by query_id order by shared desc, sim desc, memory_id) as k from w) where k <= 5", entries=False)
def needle_collector(spark, d):
    """Members that share most needle words with the query first; needle words are found once per entry."""
    words = entries(spark, d).select("memory_id", F.array_distinct(T.needle_words(F.col("text"))).alias("words"))
    m, q = branches(spark, d), query_vectors(spark, d)
    asked = q.join(words.withColumnRenamed("memory_id", "query_id"), "query_id")
    return tree.best(m.join(words, "memory_id"), tree.leaves(m, q), asked, 5).select("query_id", "memory_id", "shared")


@query("F13_turn_recall", f"with t as ({BEST}), g as (select a.vec_id as query_id, b.vec_id as memory_id from embeddings a join embeddings b on b.vec_id between a.vec_id and a.vec_id + 3 where a.vec_id % 50 = 0) select g.query_id, round(count(t.memory_id) / count(*), 6)::double as recall, count(t.memory_id) > 0 as hit from g left join (select * from t where r <= 10) t on t.query_id = g.query_id and t.memory_id = g.memory_id group by g.query_id", entries=False)
def turn_recall(spark, d):
    v = vectors(spark, d).select("memory_id")
    gold = v.filter("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), F.explode(F.sequence("memory_id", F.col("memory_id") + 3)).alias("memory_id")).join(v, "memory_id")
    got = metrics.overlap(gold, V.nearest(vectors(spark, d), query_vectors(spark, d), 10))
    return got.select("query_id", F.round("fidelity", 6).alias("recall"), (F.col("fidelity") > 0).alias("hit"))


@query("G1_dense_rank", f"select query_id, memory_id, r - 1 as rank from ({BEST}) where r <= 200", entries=False)
def dense_rank(spark, d):
    return recall.dense_list(vectors(spark, d), query_vectors(spark, d)).select("query_id", "memory_id", F.col("dense_rank").cast("long").alias("rank"))


@query("G2_lexical_rank", f"{HYBRID} select query_id, memory_id, lr as rank from l where lr < 200")
def lexical_rank(spark, d):
    h, _, q, _ = hybrid(spark, d)
    return recall.lexical_list(h, q).select("query_id", "memory_id", F.col("lex_rank").cast("long").alias("rank"))


@query("SO6_evidence_ids", "select memory_id, list_sort(list_distinct([memory_id % 7, memory_id % 5, memory_id % 3])) as ids from e")
def evidence_ids(spark, d):
    i = F.col("memory_id")
    return entries(spark, d).select("memory_id", F.array_sort(F.array_distinct(F.array(i % 7, i % 5, i % 3))).alias("ids"))


# Judged cases.


@query("J16_cases")
def judged(spark, d):
    """A case per conversation: its turns are the memories; some requests are unusable on purpose."""
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).alias("id"), "text"))).alias("memories"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("text")))).alias("remember"))
    asked = c.select("*", F.expr("array(named_struct('old_id', 1L, 'remember_index', 0), named_struct('old_id', 99L, 'remember_index', 0), named_struct('old_id', 1L, 'remember_index', 50))").alias("supersede"), F.expr("array(named_struct('memory_ids', array(2L, 1L), 'conclusion', 'Both of these hold at the same time.'), named_struct('memory_ids', array(1L, 1L), 'conclusion', 'One alone.'))").alias("consolidate"), F.expr("array(named_struct('memory_id', 1L), named_struct('memory_id', 77L))").alias("forget"))
    return cases.execute(asked)


@query("J17_corrected", ", q as (select memory_id as old_id from e where memory_id % 40 = 0) select old_id, row_number() over (order by old_id) + 99999 as new_id from q")
def corrected(spark, d):
    req = entries(spark, d).filter("memory_id % 40 = 0").select(F.col("memory_id").alias("old_id"), F.concat(F.lit("Corrected value of entry "), F.col("memory_id").cast("string"), F.lit(" as told")).alias("text"))
    return cases.corrections(req, 100_000)[1]


# Composite queries.


@query("L3_reranked", f"{HYBRID}, k as (select query_id, memory_id, row_number() over (partition by query_id order by fused_rank) as was from fr join h using (memory_id) where superseded_by is null), tk as (select memory_id, {TOKENS} as ts from h), s as (select query_id, k.memory_id, was, round(len(list_intersect(x.ts, y.ts)) / len(x.ts), 9) as score from k join tk x on x.memory_id = query_id join tk y on y.memory_id = k.memory_id where was <= 10) select query_id, memory_id, rank from (select *, row_number() over (partition by query_id order by score desc nulls last, was) as rank from s) where rank <= 5")
def reranked(spark, d):
    """Reranked by the share of the query's words that the entry has; a cross-encoder is a pandas_udf of the same shape."""
    h, v, q, qv = hybrid(spark, d)
    share = lambda a, b: F.size(F.array_intersect(T.tokens(a), T.tokens(b))) / F.nullif(F.size(T.tokens(a)), F.lit(0))
    return recall.reranked(recall.recall(h, v, q, qv, 10), h, q, share).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@query("L20_with_state", f"{HYBRID}, k as (select query_id, memory_id, state_key, state_value, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id) where superseded_by is null), st as (select query_id, memory_id, row_number() over (partition by query_id order by rank) as r from k where rank <= 20 and state_key is not null and state_value is not null and query_id % 100 = 0 and query_id in (select memory_id from h)) select query_id, 'text' as kind, memory_id from k where rank <= 5 union all select query_id, 'state', memory_id from st where r = 1")
def with_state(spark, d):
    """The best five texts; a question that opens with what is, what's or which also gets the first keyed state among twenty."""
    h, v, q, qv = hybrid(spark, d)
    question = q.select("query_id", F.concat(F.when(F.col("query_id") % 100 == 0, "Which is it: ").otherwise("Tell: "), F.coalesce("text", F.lit(""))).alias("question"))
    hits = graph.checkpointed(recall.recall(h, v, q, qv, 20).select("query_id", "memory_id", F.col("rank").alias("place")))
    asks = question.filter(F.lower("question").rlike(r"^(what is|what's|which)")).select("query_id")
    keyed = hits.join(h.filter("state_key is not null and state_value is not null").select("memory_id"), "memory_id", "left_semi").join(asks, "query_id", "left_semi")
    state = recall.top(keyed, [F.col("place")], 1, ["query_id"]).select("query_id", F.lit("state").alias("kind"), "memory_id")
    return hits.filter("place <= 5").select("query_id", F.lit("text").alias("kind"), "memory_id").unionByName(state)


@query("L22_associative")
def associative(spark, d):
    """Recall whose rows are raised by what the best hit's settled pattern overlaps."""
    h, v, q, qv = hybrid(spark, d)
    base = graph.checkpointed(recall.recall(h, v, q, qv, 5).select("query_id", "memory_id", F.coalesce("sim", F.lit(0.0)).alias("sim"), F.col("rank").alias("place")))
    p = patterns(spark, d)
    lead = base.filter("place = 1").join(p, "memory_id").select("query_id", "code", F.col("memory_id").alias("lead"))
    done = hopfield.settle(p, lead.select("query_id", "code"), 2)
    near = V.nearest(p.withColumnRenamed("code", "embedding"), done.select("query_id", F.col("code").alias("embedding")), 11, floor=1e-6).join(lead.select("query_id", "lead"), "query_id").filter("memory_id <> lead")
    both = base.select("query_id", "memory_id", F.col("sim").alias("s")).unionByName(near.select("query_id", "memory_id", (F.col("sim") * 0.15).alias("s")))
    return recall.top(both.groupBy("query_id", "memory_id").agg(F.round(F.sum("s"), 9).alias("score")), [F.desc("score"), F.col("memory_id")], 5, ["query_id"])


@query("M9_lessons", f"{HYBRID}, k as (select query_id, memory_id, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id) where superseded_by is null and lang = 'de') select * from k where rank <= 2")
def lessons(spark, d):
    """A side channel: two rows of one compartment beside the main recall."""
    h, v, q, qv = hybrid(spark, d)
    return recall.recall(h, v, q, qv, 2, compartment="de").select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))
