"""Capture batches: keys of hits, members by the cascade of widths, and the block that hits and batches share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import batches, recall
from ..sources.entries import NOW, entries, query_vectors, vectors
from ..sources.shared import written
from .base import query
from .memory import HYBRID, asked, hybrid
from .scalar import BLANK
from .vectors import BEST, COS

WINDOW = 7200.0

HITS = f", near as (select query_id, memory_id, sim, r as rank, app, ts from ({BEST}) join e using (memory_id) where r <= 10 and superseded_by is null)"
KEYS = "keys as (select query_id, app, key, best, row_number() over (partition by query_id order by best desc, first) as place from (select query_id, app, floor(ts / {w})::bigint as key, max(sim) as best, min(rank) as first from {hits} group by all) qualify place <= 3)"
MEMBERS = """b as (select memory_id, ts, app, w, floor(ts / (w * {w}))::bigint as bucket from e, (values (1), (6), (24)) x(w) where superseded_by is null),
z as (select app, w, bucket from b group by all having count(*) >= 2),
tk as (select k.app, k.key, min(w) as wide from (select distinct app, key from keys) k join z on z.app = k.app and z.bucket = floor(k.key * {w} / (z.w * {w}))::bigint group by all),
mem as (select tk.app, key, wide, memory_id, ts, row_number() over (partition by tk.app, key order by abs(ts - (key + 0.5) * {w}), memory_id) as rank from tk join b on b.app = tk.app and b.w = wide and b.bucket = floor(key * {w} / (wide * {w}))::bigint qualify rank <= 20)"""


def hits(spark, d):
    e = entries(spark, d).filter("superseded_by is null").select("memory_id", "ts", T.first_tag(F.col("tags"), "app:").alias("app"))
    return V.nearest(vectors(spark, d), query_vectors(spark, d), 10).join(e, "memory_id")


@query("G10_batch_keys", f"{HITS}, {KEYS.format(w=WINDOW, hits='near')} select query_id, app, key, round(best, 6) as best, place::integer as place from keys")
def batch_keys(spark, d):
    return batches.batch_keys(hits(spark, d), WINDOW).withColumn("best", F.round("best", 6))


@query("E11_batch_members", f"{HITS}, {KEYS.format(w=WINDOW, hits='near')}, {MEMBERS.format(w=WINDOW)} select app, key, wide, memory_id, ts, rank::integer as rank from mem")
def batch_members(spark, d):
    """Batches of two hours; on the tables' spacing all three widths are taken."""
    return batches.batch_members(entries(spark, d), batches.batch_keys(hits(spark, d), WINDOW), WINDOW)


def _strip(x):
    return f"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


@query(
    "L5_block_with_parents",
    f"""{HYBRID}, k as (select query_id, memory_id, h.text, h.ts, h.app, row_number() over (partition by query_id order by fused_rank) as rank from fr join h using (memory_id) where superseded_by is null),
hit as (select k.*, {COS} as sim from k join embeddings a on a.vec_id = query_id join embeddings b on b.vec_id = memory_id where rank <= 25),
pc as (select query_id, rank, printf('[#%d | %.2f | app=%s | %s]', memory_id, sim, app, floor(({NOW} - ts) / 86400)::bigint || 'd ago (' || strftime(make_timestamp((ts * 1000000)::bigint), '%m-%d') || ')') || chr(10) || case when length({_strip("coalesce(text, '')")}) > 600 then left({_strip("coalesce(text, '')")}, 599) || '…' else {_strip("coalesce(text, '')")} end as piece from hit),
pack as (select query_id, 0::bigint as rank, 0::bigint as used, []::varchar[] as ps from (select distinct query_id from pc) union all select pc.query_id, pc.rank, case when used + length(piece) + 2 <= 3600 then used + length(piece) + 2 else used end, case when used + length(piece) + 2 <= 3600 then list_append(ps, piece) else ps end from pack join pc on pc.query_id = pack.query_id and pc.rank = pack.rank + 1),
fine as (select query_id, arg_max(used, rank) as used, arg_max(ps, rank) as ps from pack group by query_id),
{KEYS.format(w=WINDOW, hits='hit')}, {MEMBERS.format(w=WINDOW)},
body as (select app, key, count(*) as n, arg_min(mem.ts, rank) as since, string_agg(coalesce(text, ''), chr(10) order by rank) as body from mem join e using (memory_id, app) group by all),
told as (select query_id, list(printf('[capture batch %s · %d entries]', strftime(make_timestamp((since * 1000000)::bigint), '%Y-%m-%d %H:%M'), n) || chr(10) || left(body, greatest(300, 2400 // batches)::bigint) order by place) as parts from (select *, count(*) over (partition by query_id) as batches from keys) join body using (app, key) group by query_id)
select query_id, printf('%.2f', best) as top_sim, len(ps)::integer as taken, used::integer as used, len(coalesce(parts, []))::integer as parents, array_to_string(list_concat(['top_sim=' || printf('%.2f', best), array_to_string(list_concat([printf('[memory block: %d entries, %d chars]', len(ps), used)], ps), chr(10) || chr(10))], coalesce(parts, [])), chr(10)) as block
from fine join (select query_id, arg_min(sim, rank) as best from hit group by query_id) using (query_id) left join told using (query_id)""",
)
def block_with_parents(spark, d):
    h, v, _, qv = hybrid(spark, d)
    h = written(h)  # read three times: the texts meet the vectors' ids once
    found = recall.recall(h, v, asked(h), qv, 25).select("query_id", "memory_id", "rank")
    both = found.join(v.select("memory_id", "embedding"), "memory_id").join(qv.withColumnRenamed("embedding", "qe"), "query_id")
    sims = both.select("query_id", "memory_id", "rank", V.cosine(F.col("embedding"), F.col("qe")).alias("sim"))
    return batches.recall_block(entries(spark, d), sims, NOW, window=WINDOW)
