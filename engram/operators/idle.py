"""Idle consolidation: a window of recent entries is distilled, each conclusion is audited against the window and kept as a proposal, and a later
promotion stores the proposals in the next version of a library.

What needs understanding is a judge's: two functions from columns to columns, which for a model are pandas UDFs. The stub keeps the turns
with the most words and supports what holds no other words than the window. Everything else is mechanical and can be repeated: a proposal's id is a
digest of its text, so a second run proposes nothing new and a second promotion stores nothing twice.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lenient
from ..functions import text as T
from ..functions import vector as V
from ..sources.shared import written
from ..sources.store import Library
from . import order


class Judge(Protocol):
    def distill(self, turns: Column) -> Column:
        """Conclusions (array of strings) from the window's turns (array of strings, oldest first)."""

    def audit(self, turns: Column, text: Column) -> Column:
        """struct(supported boolean, note string): whether the turns support the conclusion, and what they don't."""


class StubJudge:
    """Deterministic: the ``most`` different turns of the most words (``least`` at least); supported if no word is new."""

    def __init__(self, most: int = 6, least: int = 4):
        self.most, self.least = most, least

    def distill(self, turns: Column) -> Column:
        said = F.array_distinct(F.transform(turns, lambda t: F.trim(F.regexp_replace(t, r"^[^:]*:\s*", ""))))
        sized = F.transform(said, lambda t: F.struct((-F.size(T.tokens(t))).alias("n"), t.alias("t")))
        return F.transform(F.slice(F.array_sort(F.filter(sized, lambda s: s["n"] <= -self.least)), 1, self.most), lambda s: s["t"])

    def audit(self, turns: Column, text: Column) -> Column:
        new = F.array_sort(F.array_except(T.tokens(text), T.tokens(F.array_join(turns, "\n"))))
        return F.struct((F.size(new) == 0).alias("supported"), F.array_join(F.slice(new, 1, 2), "; ").alias("note"))


def window(entries: DataFrame, now: float, minutes: float, compartment: str | None = None) -> DataFrame:
    """Active entries of the last minutes; with a compartment, not those of other ones, but those of none."""
    recent = entries.filter((F.col("ts") >= now - minutes * 60) & F.col("superseded_by").isNull())
    if compartment is None:
        return recent
    return recent.filter(~F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.startswith("comp:") & (t != f"comp:{compartment}")))


def turns(recent: DataFrame, chars: int = 8000) -> DataFrame:
    """One row: the window's turns ("source: text"), oldest first, as many as fit in ``chars`` characters, the last one cut. A judge reads no more; each turn has a
    character at least, so the first ``chars`` rows are enough whatever the window holds."""
    said = F.left(F.concat(F.coalesce("source", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))), F.lit(chars))
    first = recent.select("ts", "memory_id", said.alias("said")).orderBy("ts", "memory_id").limit(chars)
    so_far = F.sum(F.length("said") + 1).over(Window.orderBy("ts", "memory_id").rowsBetween(Window.unboundedPreceding, -1))  # over ``chars`` rows at most
    kept = first.withColumn("room", chars - F.coalesce(so_far, F.lit(0))).filter("room > 0")
    items = F.array_sort(F.collect_list(F.struct("ts", "memory_id", F.expr("left(said, cast(room as int))").alias("said"))))
    return kept.agg(F.transform(items, lambda x: x["said"]).alias("turns")).filter(F.size("turns") > 0)


def propose(entries: DataFrame, now: float, judge: Judge | None = None, known: DataFrame | None = None, *, minutes: float = 180, min_turns: int = 3, compartment: str | None = None, chars: int = 8000) -> DataFrame:
    """(proposal_id, compartment, text, status, note) of a window's conclusions that aren't among the ``known`` proposals: ``proposed``, or ``refused`` with the
    reason (credential, junk, or what the audit found unsupported). A window of under ``min_turns`` entries gives none."""
    judge = judge or StubJudge()
    recent = window(entries, now, minutes, compartment)
    told = turns(recent, chars)
    enough = recent.limit(min_turns).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_turns)
    told = told.crossJoin(F.broadcast(enough)).drop("_n")  # one row each
    made = told.select("turns", F.explode(F.array_distinct(judge.distill(F.col("turns")))).alias("text")).withColumn("text", F.trim("text")).filter("text <> ''")
    judged = made.withColumn("audit", judge.audit(F.col("turns"), F.col("text")))
    reason = F.when(T.has_credential(F.col("text")), "credential").when(T.is_junk(F.col("text")), "junk").when(~F.coalesce("audit.supported", F.lit(False)), F.concat(F.lit("unsupported: "), F.coalesce("audit.note", F.lit(""))))
    name = F.lit(compartment).cast("string")
    out = judged.select(F.sha2(F.concat_ws("\n", F.coalesce(name, F.lit("")), "text"), 256).alias("proposal_id"), name.alias("compartment"), "text", F.when(reason.isNull(), "proposed").otherwise("refused").alias("status"), F.coalesce(reason, F.lit("")).alias("note"))
    return written(out if known is None else out.join(known.select("proposal_id").distinct(), "proposal_id", "left_anti"))


def promote(library: Library, proposals: DataFrame, now: float, same: float = 0.92) -> tuple[str | None, bool, DataFrame]:
    """Store the proposed texts in the next version of a library: (version, is current, what became of each proposal).

    ``stored``: a new entry of source model, tagged with its proposal and compartment, its id on from the largest. ``known``: the library has an active
    entry as similar as ``same``, or the proposal's own. Another writer's version in between makes it a conflict version, as with any save."""
    base = library.current()
    entries = library.load(base)
    tag = F.concat(F.lit("proposal:"), "proposal_id")
    asked = proposals.filter("status = 'proposed'").withColumn("tag", tag)
    there = entries.select(F.explode("tags").alias("tag")).filter(F.col("tag").startswith("proposal:")).distinct()
    fresh = written(asked.join(there, "tag", "left_anti"))
    vector = lambda df, name: df.select(F.col(name), lenient.embed_double(F.array_sort(T.tokens(F.coalesce("text", F.lit(""))))).alias("embedding"))
    numbered = written(order.before(fresh, ["proposal_id"], name="query_id"))
    near = V.nearest(vector(entries.filter("superseded_by is null"), "memory_id"), vector(numbered, "query_id"), 1, floor=same).select("query_id").distinct()
    fate = written(order.before(numbered.join(near.withColumn("_near", F.lit(True)), "query_id", "left"), ["query_id"], F.col("_near").isNull(), "place"))
    top = entries.agg(F.coalesce(F.max("memory_id"), F.lit(-1)).alias("top"))
    stored = fate.filter("_near is null").crossJoin(F.broadcast(top))  # one row
    tags = F.concat(F.array(F.lit("consolidation"), F.col("tag")), F.when(F.col("compartment").isNotNull(), F.array(F.concat(F.lit("comp:"), "compartment"))).otherwise(F.array().cast("array<string>")))
    new = stored.select((F.col("top") + 1 + F.col("place")).alias("memory_id"), "text", F.lit(now).alias("ts"), F.lit(now).alias("last_accessed"), F.lit("model").alias("source"), tags.alias("tags"), F.lit(now).alias("valid_from"))
    new = written(new)
    done = asked.select("proposal_id").join(fate.filter("_near is null").select("proposal_id", F.lit("stored").alias("fate")), "proposal_id", "left").select("proposal_id", F.coalesce("fate", F.lit("known")).alias("fate"))
    done = written(done)
    if not new.take(1):
        return base, True, done
    version, current = library.save(entries.unionByName(new, allowMissingColumns=True), base)
    return version, current, done
