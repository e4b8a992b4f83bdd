"""Lifecycle operators: each a pure function from entries to entries or to a report; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DAY = 86400.0


def decay(now: float, tau: float) -> Column:
    return T.decay_weight(F.col("last_accessed"), F.col("access_count"), F.col("source"), now, tau)


def close_keyed(entries: DataFrame, key: str = "key", order: str = "memory_id") -> DataFrame:
    """Active-unique per key in batch form: each keyed row's successor is the next write of that key, whose time ends its validity."""
    w = Window.partitionBy(key).orderBy(order)
    keyed = F.col(key).isNotNull()
    return entries.withColumn("next_id", F.when(keyed, F.lead("memory_id").over(w))).withColumn("next_ts", F.when(keyed, F.lead("ts").over(w)))


def organize(entries: DataFrame) -> DataFrame:
    """Rows to retire among active ones: (memory_id, keeper, reason). Older rows of a state key, and exact repeats of a text; the newest stays."""
    live = entries.filter("superseded_by is null")

    def older(key: Column, reason: str) -> DataFrame:
        keyed = live.select("memory_id", "ts", key.alias("_k")).filter("_k is not null")
        best = keyed.groupBy("_k").agg(F.max(F.struct("ts", "memory_id")).alias("_b"))
        return keyed.join(best, "_k").filter("memory_id <> _b.memory_id").select("memory_id", F.col("_b.memory_id").alias("keeper"), F.lit(reason).alias("reason"))

    return older(T.state_key(F.col("state_key")), "stale_key").unionByName(older(F.sha2(T.plain(F.col("text")), 256), "exact_repeat"))


def rotation(live: DataFrame, offset: int, pool: int) -> DataFrame:
    """(memory_id, ts) of ``pool`` entries, newest first from place ``offset`` on, in a circle: after the oldest comes the newest."""
    newest = [F.desc("ts"), F.desc("memory_id")]
    n = live.agg(F.count(F.lit(1)).alias("_n"))
    top = live.select("memory_id", "ts").orderBy(*newest).limit(offset + pool)  # a place beyond these isn't asked for
    ranked = top.withColumn("_at", F.row_number().over(Window.orderBy(*newest)) - 1).crossJoin(F.broadcast(n))  # one row
    return ranked.filter(F.pmod(F.col("_at") - offset, F.col("_n")) < pool).select("memory_id", "ts")


def retired_at(entries: DataFrame) -> Column:
    """When a superseded entry retired: the end of its validity, else its last update (where there is such a column), else its own
    time. A stamp of 0 counts as none."""
    stamps = [F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("valid_to", "updated_at") if c in entries.columns]
    return F.coalesce(*stamps, F.col("ts").cast("double"), F.lit(0.0))


def vacuum(entries: DataFrame, now: float, older_than_days: float) -> DataFrame:
    """Entries without superseded rows that retired before the cutoff."""
    return entries.filter(~(F.col("superseded_by").isNotNull() & (retired_at(entries) < now - max(0.0, older_than_days) * DAY)))


def decay_cleanup(entries: DataFrame, now: float, tau: float, least: float, protect: bool = False) -> DataFrame:
    """Entries whose retention reaches ``least`` (a third of it for judged sources if ``protect``), evidence scrubbed of the removed."""
    limit = F.when(F.col("source").isin("model", "import"), least / 3).otherwise(least) if protect else F.lit(least)
    marked = entries.withColumn("_stays", decay(now, tau) >= limit)
    return scrub(marked.filter("_stays").drop("_stays"), marked.filter(~F.col("_stays")).select("memory_id"))


def scrub(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Evidence lists without removed ids; rows without evidence take no part in the join."""
    links = entries.select("memory_id", F.explode("evidence_ids").alias("_e"))
    gone = links.join(removed.select(F.col("memory_id").alias("_e")).distinct(), "_e", "left_semi").groupBy("memory_id").agg(F.collect_set("_e").alias("_gone"))
    out = entries.join(gone, "memory_id", "left")
    return out.withColumn("evidence_ids", F.when(F.col("_gone").isNull(), F.col("evidence_ids")).otherwise(F.array_except("evidence_ids", "_gone"))).select(*entries.columns)


def forget(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return scrub(entries.join(ids.select("memory_id"), "memory_id", "left_anti"), ids)


def redact(entries: DataFrame, now: float) -> DataFrame:
    """Credential-bearing texts redacted and tagged; (…, hits)."""
    r = T.redacted(F.col("text"))
    stamp = F.concat(F.lit("redacted:"), F.date_format(F.timestamp_seconds(F.lit(now)), "yyyy-MM-dd"))
    out = entries.withColumn("_r", r)
    return out.withColumn("text", F.col("_r.text")).withColumn("hits", F.col("_r.hits")).withColumn("tags", F.when(F.col("hits") > 0, F.array_union("tags", F.array(stamp))).otherwise(F.col("tags"))).drop("_r")


def stamp_app(tags: Column, app: str) -> Column:
    """Untagged rows are first marked legacy; then the app is added if absent."""
    has = F.exists(tags, lambda t: t.startswith("app:"))
    return F.array_union(F.when(has, tags).otherwise(F.concat(tags, F.array(F.lit("app:legacy")))), F.array(F.lit(f"app:{app}")))


def migrate_keys(entries: DataFrame) -> DataFrame:
    """Keys normalised; of the active rows of a key only the newest stays active."""
    out = entries.withColumn("state_key", T.state_key(F.col("state_key")))
    active = out.filter("superseded_by is null and state_key is not null")
    out = out.join(active.groupBy("state_key").agg(F.max(F.struct("ts", "memory_id")).alias("_b")), "state_key", "left").select(*out.columns, "_b")
    stale = F.col("_b").isNotNull() & F.col("superseded_by").isNull() & (F.col("memory_id") != F.col("_b.memory_id"))
    return out.withColumn("valid_to", F.when(stale, F.col("_b.ts")).otherwise(F.col("valid_to"))).withColumn("superseded_by", F.when(stale, F.col("_b.memory_id")).otherwise(F.col("superseded_by"))).drop("_b")


def supersede(entries: DataFrame, requests: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """One batch of independent requests (old_id, new_id): entries after it, and (old_id, new_id, ok, reason).

    Refused: the same id, unknown ids, a new row that is itself superseded, and a request whose new row's
    successors lead back to the old one. An already superseded old row is pointed anew.
    """
    from .graph import ancestry

    ids = entries.select("memory_id", "superseded_by")
    seen = requests.join(ids.select(F.col("memory_id").alias("old_id"), F.lit(True).alias("_o")), "old_id", "left")
    seen = seen.join(ids.select(F.col("memory_id").alias("new_id"), F.lit(True).alias("_n"), F.col("superseded_by").alias("_s")), "new_id", "left")
    back = ancestry(ids).select(F.col("memory_id").alias("new_id"), F.col("successor").alias("old_id"), F.lit(True).alias("_cycle"))
    seen = seen.join(back, ["new_id", "old_id"], "left")
    reason = F.when(F.col("old_id") == F.col("new_id"), "same").when(F.col("_o").isNull() | F.col("_n").isNull(), "unknown").when(F.col("_cycle"), "cycle").when(F.col("_s").isNotNull(), "new_superseded").otherwise("ok")
    outcome = seen.select("old_id", "new_id", (reason == "ok").alias("ok"), reason.alias("reason"))
    change = outcome.filter("ok").groupBy(F.col("old_id").alias("memory_id")).agg(F.max("new_id").alias("_to"))
    out = entries.join(change, "memory_id", "left")
    out = out.withColumn("valid_to", F.when(F.col("_to").isNotNull(), F.lit(now)).otherwise(F.col("valid_to"))).withColumn("superseded_by", F.coalesce("_to", "superseded_by"))
    return out.select(*entries.columns), outcome


def as_of(entries: DataFrame, t: float) -> DataFrame:
    return entries.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def digest(entries: DataFrame, buckets: int = 8, per_bucket: int = 12) -> DataFrame:
    """The largest topic buckets and, in each, the entries most used, then newest."""
    name = T.first_tag(F.col("tags"), "comp:")
    name = F.when(name != "", name).otherwise(F.when(T.first_tag(F.col("tags"), "app:") != "", T.first_tag(F.col("tags"), "app:")).otherwise("other"))
    live = entries.filter("superseded_by is null").withColumn("bucket", name)
    size = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "bucket").limit(buckets)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("access_count"), F.desc("ts"), "memory_id"))
    best = live.withColumn("rank", rank).filter(F.col("rank") <= per_bucket)
    return best.join(size, "bucket").select("bucket", "total", "rank", "memory_id", F.col("access_count").alias("uses"), F.left("text", F.lit(140)).alias("text"))
