"""The write path over conversations: every turn, told again, told with a change, and as a keyed state; with a fold in SQL as oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import idle, writes
from ..sources.entries import FIRST, NOW, entries, table
from .base import query
from .scalar import CHUNKS, LONG, MARKS, PATTERNS, TOKENS
from .streams import _DIMS, _EMPTY


def requests(spark, d):
    """Requests of a conversation: each turn (0), again (1), with a word more (2), and a short keyed fact (3). Some are forced, some turns keyed, which
    is refused where they have more than one chunk."""
    t, v = F.col("turn"), F.col("v")
    c = table(spark, d, "conversations").withColumn("v", F.explode(F.array(*map(F.lit, range(4)))))
    fact = F.concat(F.lit("topic of "), F.col("conv_id").cast("string"), F.lit(" is "), F.left(F.regexp_replace("text", "[^a-zA-Z0-9 ]", " "), F.lit(40)))
    return c.select(
        F.col("conv_id").alias("scope"), (t * 4 + v).alias("seq"),
        F.when(v == 2, F.concat("text", F.lit(" update"), t.cast("string"))).when(v == 3, fact).otherwise(F.col("text")).alias("text"),
        F.when(v == 2, F.concat(F.lit("r"), t.cast("string"))).otherwise("").alias("response"),
        F.array(F.concat(F.lit("app:"), "role")).alias("tags"), F.when(F.col("role") == "assistant", "model").when(F.col("role") == "user", "hook").otherwise("import").alias("source"),
        (F.lit(FIRST) + t * 60 + v).cast("double").alias("ts"), F.when(v == 3, F.lit(FIRST) - t * 10).cast("double").alias("timestamp"),
        ((v == 1) & (t % 3 == 0)).alias("force_new"), F.when(t % 2 == 0, "alpha").alias("compartment"),
        F.when((v == 3) | ((v == 0) & (t % 4 == 2)), F.lit(" User.Topic ")).alias("state_key"), F.when(v == 3, F.concat(F.lit("v"), t.cast("string"))).alias("state_value"),
    )


_ROW = "struct(id bigint, text varchar, tok varchar[], emb double[], response varchar, source varchar, ts double, seen double, uses bigint, tags varchar[], sup bigint, upd double, vf double, vt double, key varchar, val varchar)"
_RANK = "(case {} when 'model' then 3 when 'import' then 2 when 'hook' then 1 else 0 end)"
_SET = "{{'id': r.id, 'text': {text}, 'tok': {tok}, 'emb': {emb}, 'response': {response}, 'source': {source}, 'ts': r.ts, 'seen': x.ts, 'uses': r.uses + 1, 'tags': r.tags, 'sup': r.sup, 'upd': {upd}, 'vf': r.vf, 'vt': r.vt, 'key': r.key, 'val': r.val}}"
_STRENGTHENED = _SET.format(text="r.text", tok="r.tok", emb="r.emb", response="r.response", source="r.source", upd="r.upd")
_MERGED = _SET.format(text="x.chunk", tok="x.tok", emb="x.emb", response="case when x.response <> '' then x.response else r.response end", source=f"case when {_RANK.format('x.source')} >= {_RANK.format('r.source')} then x.source else r.source end", upd="case when r.text <> x.chunk then x.ts else r.upd end")
_STONE = "{'id': len(rows)::bigint, 'text': best.text, 'tok': best.tok, 'emb': best.emb, 'response': best.response, 'source': best.source, 'ts': best.ts, 'seen': best.seen, 'uses': 0::bigint, 'tags': best.tags, 'sup': best.id, 'upd': null::double, 'vf': coalesce(nullif(best.vf, 0), best.ts), 'vt': x.ts, 'key': best.key, 'val': null::varchar}"
_NEW = "{'id': len(rows)::bigint, 'text': x.chunk, 'tok': x.tok, 'emb': x.emb, 'response': x.response, 'source': x.source, 'ts': x.made, 'seen': x.made, 'uses': 0::bigint, 'tags': x.tags, 'sup': null::bigint, 'upd': null::double, 'vf': x.made, 'vt': null::double, 'key': x.key, 'val': x.state_value}"
_OLD = "{'id': r.id, 'text': r.text, 'tok': r.tok, 'emb': r.emb, 'response': r.response, 'source': r.source, 'ts': r.ts, 'seen': r.seen, 'uses': r.uses, 'tags': r.tags, 'sup': case when x.key is not null and r.key = x.key and r.sup is null then len(rows)::bigint else r.sup end, 'upd': r.upd, 'vf': r.vf, 'vt': case when x.key is not null and r.key = x.key and r.sup is null then x.made else r.vt end, 'key': r.key, 'val': r.val}"

#: Requests to chunks; then the chunks of a scope folded one by one into a list of rows.
FOLDED = rf"""with recursive rq as (select conv_id * 100000 + turn * 4 + v as memory_id, conv_id as scope, turn * 4 + v as seq, coalesce(case when v = 2 then text || ' update' || turn when v = 3 then 'topic of ' || conv_id || ' is ' || left(regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g'), 40) else text end, '') as text,
  case when v = 2 then 'r' || turn else '' end as response, ['app:' || role] || case when turn % 2 = 0 then ['comp:alpha'] else []::varchar[] end as tags, case role when 'assistant' then 'model' when 'user' then 'hook' else 'import' end as source,
  ({FIRST} + turn * 60 + v)::double as ts, case when v = 3 then ({FIRST} - turn * 10)::double else ({FIRST} + turn * 60 + v)::double end as made, v = 1 and turn % 3 = 0 as force_new, case when v = 3 or (v = 0 and turn % 4 = 2) then 'user.topic' end as key, case when v = 3 then 'v' || turn end as state_value
  from conversations, range(4) q(v)){CHUNKS.replace('from e),', 'from rq),').replace('select memory_id, unnest(range(0, len(cs))) as pos, unnest(cs) as chunk from c', '')},
ch as (select * from (select memory_id, unnest(range(0, len(cs)))::integer as k, unnest(cs) as text from c) where not ({_EMPTY})),
n as (select rq.*, (({MARKS}) or ({PATTERNS}) or ({LONG})) as bad, (select count(*) from ch where ch.memory_id = rq.memory_id) as n from rq),
refused as (select scope, seq, case when bad then 'credential' when n = 0 then 'empty' else 'keyed_chunks' end as action from n where bad or n = 0 or (key is not null and n > 1)),
w as (select n.* exclude (text), ch.text as chunk, row_number() over (partition by n.memory_id order by k)::integer - 1 as pos, list_sort({TOKENS.replace('(text)', '(ch.text)')}) as tok from n join ch using (memory_id) where not bad and (key is null or n = 1)),
dims as (select scope, seq, pos, dim, count(*)::double as c from (select scope, seq, pos, unnest({_DIMS.format(t='tok')}) as dim from w) group by all),
emb as (select scope, seq, pos, map_from_entries(list((dim, c))) as m, sqrt(sum(c * c)) as norm from dims group by all),
x as (select w.*, list_transform(range(256), lambda i: coalesce(m[i], 0) / (coalesce(norm, 0) + 1e-9)) as emb, row_number() over (partition by scope order by seq, pos) as i from w left join emb using (scope, seq, pos)),
f as (
  select distinct scope, 0::bigint as i, []::{_ROW}[] as rows, null::bigint as seq, null::integer as pos, null::varchar as action, null::bigint as mid, null::double as novelty from x
  union all
  select scope, i, case action when 'strengthened' then list_transform(rows, lambda r: case when r.id = best.id then {_STRENGTHENED} else r end)
    when 'merged' then list_concat(list_transform(rows, lambda r: case when r.id = best.id then {_MERGED} else r end), case when best.text <> x.chunk then [{_STONE}] else [] end)
    else list_append(list_transform(rows, lambda r: {_OLD}), {_NEW}) end, x.seq, x.pos, action, case when action = 'new' then len(rows) else best.id end, 1 - sim
  from (select *, case when best is not null and sim > case when len(x.chunk) < 30 then 0.95 else 0.92 end and len(list_filter(x.tok, lambda t: not list_contains(best.tok, t))) = 0 then 'strengthened'
      when best is not null and sim > case when len(x.chunk) < 30 then 0.85 else 0.75 end then 'merged' else 'new' end as action
    from (select scope, i, rows, x, case when x.key is null then live[list_position(sims, list_max(sims))] end as best, case when len(live) = 0 then 0 when x.key is not null then -1 else list_max(sims) end as sim
      from (select *, list_transform(live, lambda r: round(list_dot_product(r.emb, x.emb), 9)) as sims
        from (select f.scope, x.i, f.rows, x, case when x.force_new then []::{_ROW}[] else list_filter(f.rows, lambda r: r.sup is null) end as live from f join x on x.scope = f.scope and x.i = f.i + 1)))))"""

OUTCOMES = f"{FOLDED}, out as (select scope, seq, pos, action, mid as memory_id, novelty from f where i > 0 union all select scope, seq, 0, action, null, 0 from refused)"


@query("J1_outcomes", f"{OUTCOMES} select scope, seq, pos, action, memory_id, round(novelty, 7) as novelty from out", entries=False)
def outcomes(spark, d):
    return writes.outcomes(writes.remember(requests(spark, d))).withColumn("novelty", F.round("novelty", 7))


@query("J2_requests", f"{OUTCOMES} select scope, seq, case when count(distinct memory_id) = 0 then 'rejected' when count(distinct action) = 1 then min(action) else 'mixed' end as action, min(action) filter (memory_id is null) as reason, count(*) filter (action = 'new') as new, count(*) filter (action = 'merged') as merged, count(*) filter (action = 'strengthened') as strengthened, coalesce(list(memory_id order by pos) filter (memory_id is not null), []) as memory_ids, round(arg_max(novelty, pos), 7) as novelty from out group by scope, seq", entries=False)
def requests_done(spark, d):
    return writes.requests_done(writes.outcomes(writes.remember(requests(spark, d)))).withColumn("novelty", F.round("novelty", 7))


@query("J3_library", f"{FOLDED}, l as (select scope, unnest(rows) as r from f qualify row_number() over (partition by scope order by i desc) = 1) select scope, r.id as memory_id, r.text as text, r.response as response, r.source as source, r.ts as ts, r.seen as last_accessed, r.uses as access_count, r.tags as tags, r.sup as superseded_by, r.upd as updated_at, r.vf as valid_from, r.vt as valid_to, r.key as state_key, r.val as state_value from l", entries=False)
def library(spark, d):
    """All rows after the fold: merges leave tombstones, keyed writes close the key's row before."""
    return writes.entries(writes.remember(requests(spark, d)))


def operations(spark, d):
    """A log of each conversation: its turns remembered, later turns superseding earlier ones, pairs consolidated, some rows forgotten; some operations ask
    for ids that there aren't, or make a cycle."""
    t = F.col("turn")
    c = table(spark, d, "conversations").withColumn("op", F.explode(F.array(*map(F.lit, ("remember", "supersede", "consolidate", "forget", "merge")))))
    c = c.filter((F.col("op") == "remember") | ((F.col("op") == "supersede") & (t % 2 == 1)) | ((F.col("op") == "consolidate") & (t % 3 == 2)) | ((F.col("op") == "forget") & (t % 4 == 3)) | ((F.col("op") == "merge") & (t == 5)))
    place = F.element_at(F.create_map(*(F.lit(x) for x in ("remember", 0, "supersede", 1, "consolidate", 2, "forget", 3, "merge", 4))), F.col("op"))
    return c.select(
        F.col("conv_id").alias("scope"), (t * 5 + place).alias("seq"), "op", (F.lit(FIRST) + t * 60).cast("double").alias("ts"), F.lit("model").alias("source"),
        F.when(F.col("op") == "remember", F.col("text")).when(F.col("op") == "consolidate", F.concat(F.lit("Both turns agree, as of turn "), t.cast("string"))).alias("text"),
        F.when(t % 8 == 5, t).otherwise(t - 1).alias("old_id"), F.when(t % 8 == 5, t - 1).otherwise(t).alias("new_id"), F.array(t, t - 1, t).alias("memory_ids"), (t * 2 - 3).alias("memory_id"),
    )


@query("J18_log")
def log_outcomes(spark, d):
    return writes.replay(operations(spark, d))[0]


@query("J18_library")
def log_library(spark, d):
    return writes.replay(operations(spark, d))[1].drop("text")


@query("M7_proposals")
def proposals(spark, d):
    """What a window of the last fourteen days leads to, for two of the compartments, by the stub judge."""
    e = entries(spark, d)
    return idle.propose(e, NOW, minutes=20_000, compartment="fr").unionByName(idle.propose(e, NOW, minutes=20_000, compartment="de")).select("proposal_id", "compartment", "text", "status", "note")
