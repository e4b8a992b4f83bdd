"""Scalar function queries (survey group B) and filters (group D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle
from ..sources.entries import NOW, entries, table
from .base import query

TOKENS = r"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: len(x) >= 2))"
MARKS = " or ".join(f"contains(text, '{m}')" for m in T.CREDENTIAL_MARKS)
PATTERNS = " or ".join(f"regexp_matches(text, '{p}')" for p in T.CREDENTIAL_PATTERNS)
#: The look-ahead pattern without look-ahead: a long token with one of the words later on its line.
LONG = r"regexp_matches(text, '(?i)\b[A-Za-z0-9_-]{40,}\b.*(key|token|secret)') or regexp_matches(text, '(?i)\b[A-Za-z0-9_-]{40,}\b(key|token|secret)')"


@query("B1_tokens", f"select memory_id, len({TOKENS}) as n_tokens from e")
def tokens(spark, d):
    return entries(spark, d).select("memory_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("B2_junk", r"select memory_id, len(text) = 0 or len(regexp_replace(text, '[^A-Za-z0-9\x{4e00}-\x{9fff}]', '', 'g')) / greatest(len(text), 1) < 0.45 or len(regexp_replace(text, '[^A-Za-z0-9\x{4e00}-\x{9fff}]', '', 'g')) < 4 as junk from e")
def junk(spark, d):
    return entries(spark, d).select("memory_id", T.is_junk(F.col("text")).alias("junk"))


@query("B3_state_key", "select memory_id, nullif(lower(trim(state_key)), '') as k from e")
def state_key(spark, d):
    return entries(spark, d).select("memory_id", T.state_key(F.col("state_key")).alias("k"))


BLANK = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


CHUNKS = rf""", s as (select memory_id, list_filter(list_transform(regexp_extract_all(text, '[^{T.ENDS}\n]*[{T.ENDS}\n]|[^{T.ENDS}\n]+'), lambda x: {_strip_sql('x')}), lambda x: x <> '') as ps from e),
r as (select memory_id, flatten(list_transform(ps, lambda p: case when len(p) > 120 then regexp_extract_all(regexp_replace(p, '([{T.COMMAS}])[{BLANK}]+', '\1', 'g'), '(?s).{{1,120}}\z|.{{0,119}}[{T.COMMAS}]|[^{T.COMMAS}]*[{T.COMMAS}]|[^{T.COMMAS}]+') else [p] end)) as p from s),
t as (select memory_id, p, list_filter(range(1, len(p) + 1), lambda i: not (i > 1 and len(p[i]) < 10 and not regexp_matches(p[i - 1], '[{T.ENDS}…]$'))) as st from r),
c as (select memory_id, list_filter(list_transform(range(1, len(st) + 1), lambda k: {_strip_sql("array_to_string(p[st[k]:coalesce(st[k + 1] - 1, len(p))], '')")}), lambda x: x <> '') as cs from t)
select memory_id, unnest(range(0, len(cs))) as pos, unnest(cs) as chunk from c"""


@query("B4_chunks", CHUNKS)
def chunks(spark, d):
    return entries(spark, d).select("memory_id", F.posexplode(T.chunks(F.col("text"))).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query("B5_credential", f"select memory_id, ({MARKS}) or ({PATTERNS}) or ({LONG}) as found from e")
def credential(spark, d):
    return entries(spark, d).select("memory_id", T.has_credential(F.col("text")).alias("found"))


@query("B6_redact")
def redact(spark, d):
    return entries(spark, d).select("memory_id", T.redacted(F.col("text")).alias("r")).select("memory_id", "r.text", "r.hits")


@query("B7_app_slug", r"select distinct lang || ' App/' || app as name, left(trim(regexp_replace(lower(trim(lang || ' App/' || app)), '[^a-z0-9_.-]+', '-', 'g'), '-._'), 32) as slug from e")
def app_slug(spark, d):
    name = F.concat("lang", F.lit(" App/"), "app")
    return entries(spark, d).select(name.alias("name"), T.app_slug(name).alias("slug")).distinct()


@query("B8_apps", "select memory_id, app as apps from e")
def apps(spark, d):
    return entries(spark, d).select("memory_id", T.apps(F.col("tags")).alias("apps"))


@query("B9_first_app", "select memory_id, app as first_app, lang as comp from e")
def first_app(spark, d):
    return entries(spark, d).select("memory_id", T.first_tag(F.col("tags"), "app:").alias("first_app"), T.first_tag(F.col("tags"), "comp:").alias("comp"))


def _cut_sql(n: int) -> str:
    h = f"left(text, {n})"
    parts = ", ".join(f"case when contains({h}, '{m}') and {n} - strpos(reverse({h}), '{m}') >= {n * 0.5} then left(text, {n} - strpos(reverse({h}), '{m}') + 1) end" for m in T.CUT_MARKS)
    return f"case when len(text) <= {n} then text else coalesce({parts}, {h}) end"


@query("B10_cut", f"select memory_id, {_cut_sql(140)} as head from e")
def cut(spark, d):
    return entries(spark, d).select("memory_id", T.cut(F.col("text"), 140).alias("head"))


@query("B11_age", f"select memory_id, cast(floor(({NOW} - ts) / 86400) as bigint) || 'd ago (' || strftime(make_timestamp((ts * 1000000)::bigint), '%m-%d') || ')' as age from e where {NOW} - ts >= 86400")
def age(spark, d):
    return entries(spark, d).filter(NOW - F.col("ts") >= 86400).select("memory_id", T.age_label(F.col("ts"), NOW).alias("age"))


def _route_sql(column: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains(lower({column}), '{w}')" for w in words) + f" then '{name}'" for name, words in T.ROUTES) + " else 'lookup' end"


@query("B12_route", f"select conv_id, turn, {_route_sql('text')} as route from conversations", entries=False)
def route(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.route(F.col("text")).alias("route"))


@query("B13_plain", r"select md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as k, count(*) as n from e group by 1")
def plain(spark, d):
    return entries(spark, d).groupBy(F.md5(T.plain(F.col("text"))).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("B14_dates", "select event_id, cast(epoch(date_trunc('minute', ts)) as double) as at from events", entries=False)
def dates(spark, d):
    return table(spark, d, "events").select("event_id", T.dated(F.date_format("ts", "yyyy/MM/dd '('E')' HH:mm")).alias("at"))


@query("B17_top_sim", "select memory_id, cast((memory_id % 100) / 100.0 as double) as sim from e")
def top_sim(spark, d):
    line = F.format_string("[#%d | %.2f | x] text", "memory_id", (F.col("memory_id") % 100) / 100.0)
    return entries(spark, d).select("memory_id", T.top_sim(line).alias("sim"))


@query("B18_tags", r"select page_id, len(regexp_replace(html, '(?i)<(/?\s*p\s*>)', '&lt;\1', 'g')) as n from pages", entries=False)
def neutral(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.without_tags(F.col("html"), "p")).cast("long").alias("n"))


@query("B19_confidence", "select user_id, max(v) < 40 and coalesce(max(v) - max(v, 2)[2], 0) < 12 as low from (select user_id, value as v from events) group by user_id", entries=False)
def confidence(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")).select("user_id", T.low_confidence(F.col("v"), 40.0, 12.0).alias("low"))


@query("B20_gate", "select memory_id, not (len(text) < 2 or starts_with(ltrim(text), '<system-reminder') or contains(left(ltrim(text), 200), 'AUTOMATION-DISPATCH:') or contains(text, 'pypi-') or " + MARKS + ") as admitted from e")
def gate(spark, d):
    return entries(spark, d).select("memory_id", T.admits_prompt(F.col("text")).alias("admitted"))


@query("B21_session", r"select memory_id, regexp_replace('session_' || app || '_' || memory_id, '_[0-9]+$', '') as session from e")
def session(spark, d):
    return entries(spark, d).select("memory_id", T.session_of(F.concat_ws("_", F.lit("session"), "app", "memory_id")).alias("session"))


@query("B22_needles", r"select memory_id, len(list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: regexp_full_match(x, '\p{L}+') and not list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], x))) as n from e")
def needles(spark, d):
    return entries(spark, d).select("memory_id", F.size(T.needle_words(F.col("text"))).cast("long").alias("n"))


@query("B23_overlap", r", w as (select memory_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_full_match(x, '\p{L}+') and not list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], x)) as ws from e) select a.memory_id, list_has_any(a.ws, b.ws) as shared from w a join w b on b.memory_id = a.memory_id + 1")
def overlap(spark, d):
    w = entries(spark, d).select("memory_id", T.needle_words(F.col("text")).alias("ws"))
    return w.join(w.select((F.col("memory_id") - 1).alias("memory_id"), F.col("ws").alias("other")), "memory_id").select("memory_id", F.arrays_overlap("ws", "other").alias("shared"))


@query("B24_squeezed", r"select memory_id, left(regexp_replace(text, '\s+', '', 'g'), 18) as q from e")
def squeezed(spark, d):
    return entries(spark, d).select("memory_id", T.squeezed(F.col("text")).alias("q"))


@query("B25_hash_bits", r", w as (select memory_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+'), lambda x: x <> '')) as word from e), c as (select memory_id, ('0x' || right(md5(word || '_' || h), 3))::bigint as bit, count(*) as n from w, range(3) r(h) group by all), p as (select *, rank() over (partition by memory_id order by n desc) as place from c) select memory_id, count(*) as n_bits, string_agg(bit, ',' order by bit) as bits from p where place <= 204 group by memory_id")
def hash_bits(spark, d):
    code = T.hash_code(entries(spark, d), "memory_id", "text")
    return code.select("memory_id", F.size("code").cast("long").alias("n_bits"), F.array_join("code", ",").alias("bits"))


@query("B26_pair_text", "select a.conv_id, a.turn, md5(a.text || ' ||| ' || b.text) as pair from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 and a.role = 'user'", entries=False)
def pair_text(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.filter("role = 'user'").join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(F.concat_ws(" ||| ", "text", "reply")).alias("pair"))


@query("C20_decay", f"select memory_id, round(least(pow(1 + ({NOW} - last_accessed) / case when source = 'model' then 2 * 2592000.0 else 2592000.0 end, -0.5) * (1 + 0.5 * log2(1 + access_count)), 1.0), 6) as weight from e")
def decay(spark, d):
    w = T.decay_weight(F.col("last_accessed"), F.col("access_count"), F.col("source"), NOW, 2592000.0)
    return entries(spark, d).select("memory_id", F.round(w, 6).alias("weight"))


@query("C21_source_weight", "select source, count(*) as n, case source when 'model' then 1.15::double when 'import' then 1.15::double when 'hook' then 0.9::double else 1.0::double end as weight from e group by source")
def source_weight(spark, d):
    return entries(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", T.source_weight(F.col("source")))


@query("D1_active", "select memory_id from e where superseded_by is null")
def active(spark, d):
    return entries(spark, d).filter("superseded_by is null").select("memory_id")


@query("D2_compartment", "select memory_id from e where lang = 'fr'")
def compartment(spark, d):
    return entries(spark, d).filter(F.array_contains("tags", "comp:fr")).select("memory_id")


@query("D3_judged", "select memory_id, source from e where source in ('model', 'import')")
def judged(spark, d):
    return entries(spark, d).filter(F.col("source").isin("model", "import")).select("memory_id", "source")


@query("D4_window", f"select memory_id, ts from e where ts >= {NOW} - 14 * 86400")
def window(spark, d):
    return entries(spark, d).filter(F.col("ts") >= NOW - 14 * 86400).select("memory_id", "ts")


@query("D7_scope", "select memory_id from e where not (lang <> 'en')")
def scope(spark, d):
    return entries(spark, d).filter(~F.exists("tags", lambda t: t.startswith("comp:") & (t != "comp:en"))).select("memory_id")


@query("D9_retired", f"select memory_id from e where superseded_by is not null and coalesce(valid_to, ts) < {NOW} - 20 * 86400")
def retired(spark, d):
    e = entries(spark, d)
    return e.filter(F.col("superseded_by").isNotNull() & (lifecycle.retired_at(e) < NOW - 20 * 86400)).select("memory_id")


@query("D11_rotation", ", r as (select memory_id, row_number() over (order by ts desc, memory_id desc) as rn, count(*) over () as n from e where superseded_by is null) select memory_id from r where (rn - 1 - 30 + n) % n < 100")
def rotation(spark, d):
    return lifecycle.rotation(entries(spark, d).filter("superseded_by is null"), offset=30, pool=100).select("memory_id")
