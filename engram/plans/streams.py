"""Queries that run as streams: keyed state with back-dated rows, expiry, the capture loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.entries import FIRST
from ..sources.shared import new_folder
from ..streaming import loop, state
from .base import query
from .scalar import LONG, MARKS, PATTERNS, TOKENS

DAY = 86400.0


def writes(events):
    """Keyed writes in the order of event ids, every seventh back-dated by three days."""
    ts = F.col("ts").cast("timestamp").cast("double") - F.when(F.col("event_id") % 7 == 3, 3 * DAY).otherwise(0.0)
    return events.select(F.concat_ws(".", F.col("user_id").cast("string"), "event_type").alias("state_key"), F.col("event_id").alias("memory_id"), F.col("event_id").alias("arrival"), ts.alias("ts"))


WRITES = f"w as (select concat_ws('.', user_id::varchar, event_type) as state_key, event_id as memory_id, epoch_us(ts) / 1e6 - case when event_id % 7 = 3 then {3 * DAY} else 0 end as ts from events)"


@query("M5_active_unique", f"with {WRITES} select state_key, memory_id, lead(memory_id) over k as superseded_by, round(lead(ts) over k, 3) as valid_to, case when lead(memory_id) over k is null then 'active' else 'replaced' end as status from w window k as (partition by state_key order by memory_id)", entries=False)
def active_unique(spark, d):
    """By arrival, whatever the rows' own times."""
    changes = state.drained(state.active_unique(writes(state.table_stream(spark, d, "events"))))
    return state.resolved(changes).withColumn("valid_to", F.round("valid_to", 3))


@query("M6_idle_expiry", f"with {WRITES}, n as (select *, lead(memory_id) over k as next_id, lead(ts) over k as next_ts from w window k as (partition by state_key order by memory_id)), m as (select max(ts) - {DAY} as mark from w), s as (select *, case when next_ts is not null and next_ts < ts + {5 * DAY} then 'replaced' when next_ts is not null or ts + {5 * DAY} <= mark then 'expired' else 'active' end as status from n, m) select state_key, memory_id, case when status = 'replaced' then next_id end as superseded_by, round(case status when 'replaced' then next_ts when 'expired' then ts + {5 * DAY} end, 3) as valid_to, status from s", entries=False)
def idle_expiry(spark, d):
    """The same state, closed after five days without a write; the watermark is a day behind."""
    changes = state.drained(state.active_unique(writes(state.table_stream(spark, d, "events")), late="1 day", idle=5 * DAY))
    return state.resolved(changes).withColumn("valid_to", F.round("valid_to", 3))


def messages(turns):
    """User turns with the assistant's next turn as response; a conversation's turns arrive together."""
    ts = (F.lit(FIRST) + F.col("conv_id") * 600 + F.col("turn") * 20).cast("double")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.concat(F.lit("chat"), (F.col("conv_id") % 3).cast("string")).alias("app"), F.col("text").alias("context"), ts.alias("ts"))
    said = turns.filter("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.min("text").alias("response"))
    return asked.join(said, ["conv_id", "turn"], "left").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "app", "context", "response", "ts")


_DIMS = "flatten(list_transform({t}, lambda w: [('0x' || substr(md5(w), 1, 2))::integer, ('0x' || substr(md5(w), 9, 2))::integer, ('0x' || substr(md5(w), 17, 2))::integer]))"
_VECTOR = lambda name, text: f"{name}c as (select id, ts, dim, count(*)::double as c from (select id, ts, unnest({_DIMS.format(t=TOKENS.replace('(text)', '(' + text + ')'))}) as dim from s) group by all), {name} as (select id, ts, dim, c / (n + 1e-9) / (n / (n + 1e-9) + 1e-8) as c from {name}c join (select id, sqrt(sum(c * c)) as n from {name}c group by id) using (id))"
_EMPTY = "coalesce(text, '') = '' or len(regexp_replace(text, '[^A-Za-z0-9\\x{4e00}-\\x{9fff}]', '', 'g')) / greatest(len(text), 1) < 0.45 or len(regexp_replace(text, '[^A-Za-z0-9\\x{4e00}-\\x{9fff}]', '', 'g')) < 4"


@query(
    "M1_capture_loop",
    f"""with a as (select conv_id, turn - 1 as turn, min(text) as response from conversations where role = 'assistant' group by all),
s as (select u.conv_id * 1000 + u.turn as id, u.conv_id, ({FIRST} + u.conv_id * 600 + u.turn * 20)::double as ts, coalesce(u.text, '') as context, coalesce(u.text, '') || case when coalesce(response, '') <> '' then ' ||| ' || response else '' end as text from conversations u left join a using (conv_id, turn) where role = 'user'),
o as (select id, ts, conv_id, not (({MARKS}) or ({PATTERNS}) or ({LONG}) or {_EMPTY}) as stored from s),
{_VECTOR('m', 'text')}, {_VECTOR('q', 'context')},
near as (select q.id, m.id as memory_id, round(sum(q.c * m.c), 9) as sim from q join o qo on qo.id = q.id and qo.conv_id % 50 = 0 join m on m.dim = q.dim and m.ts < q.ts join o mo on mo.id = m.id and mo.stored group by all),
recalled as (select id, memory_id, sim, row_number() over (partition by id order by sim desc, memory_id) as rank from near qualify row_number() over (partition by id order by sim desc, memory_id) <= 3),
trail as (select q.id, m.id as memory_id, row_number() over (partition by q.id order by m.ts desc, m.id desc) as rank from o q join o m on m.stored and m.ts < q.ts and m.ts >= q.ts - 5400 where q.conv_id % 50 = 0)
select id as message_id, 'recalled' as channel, rank::integer as rank, memory_id, round(sim, 6) as sim from recalled where sim > 0.4
union all select id, 'recent', rank::integer, memory_id, null from trail where rank <= 6 and not exists (from recalled r where r.id = trail.id and r.memory_id = trail.memory_id and r.sim > 0.4)""",
    entries=False,
)
def capture_loop(spark, d):
    """All messages are stored as they come; those of every fiftieth conversation recall."""
    turns = state.table_stream(spark, d, "conversations")
    found = loop.capture_loop(turns, new_folder(spark), asks=F.floor(F.col("message_id") / 1000) % 50 == 0, prepare=messages)
    return found.select("message_id", "channel", "rank", "memory_id", F.round("sim", 6).alias("sim"))
