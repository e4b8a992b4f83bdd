"""Memory entries over the driver's tables: the mapping, and the same mapping as SQL for oracles.

``documents`` are the entries' facts; lineage, keys, access counts and validity are derived from the id, so
that every lifecycle operator has rows to work on. ``embeddings`` share ids with documents by convention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all time-dependent queries; operators take ``now`` as a parameter.
NOW = 1_701_000_000.0
FIRST = 1_700_000_000

ENTRIES_SQL = f"""e as (select doc_id as memory_id, text, lang, source as app, cast({FIRST} - doc_id * 1800 as double) as ts,
cast({FIRST} - doc_id * 1800 + (doc_id % 7) * 86400 as double) as last_accessed, doc_id % 11 as access_count,
case doc_id % 4 when 0 then 'hook' when 1 then 'model' when 2 then 'import' else 'auto' end as source,
case when doc_id % 17 in (3, 4) then doc_id + 1 end as superseded_by,
case when doc_id % 5 = 0 then concat(' User.K', cast(doc_id % 23 as varchar)) end as state_key,
case when doc_id % 5 = 0 then concat('v', cast(doc_id as varchar)) end as state_value,
cast({FIRST} - doc_id * 1800 as double) as valid_from,
case when doc_id % 17 in (3, 4) then cast({FIRST} - doc_id * 1800 + 3600 as double) end as valid_to from documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry table (memory_id, text, tags, times, lineage, keys)."""
    i = F.col("doc_id")
    ts = (F.lit(FIRST) - i * 1800).cast("double")
    old = (i % 17).isin(3, 4)
    keyed = i % 5 == 0
    return table(spark, sf_dir, "documents").select(
        i.alias("memory_id"),
        "text",
        "lang",
        F.col("source").alias("app"),
        ts.alias("ts"),
        (F.lit(FIRST) - i * 1800 + (i % 7) * 86400).cast("double").alias("last_accessed"),
        (i % 11).alias("access_count"),
        F.element_at(F.array(*map(F.lit, ("hook", "model", "import", "auto"))), (i % 4 + 1).cast("int")).alias("source"),
        F.array(F.concat(F.lit("comp:"), "lang"), F.concat(F.lit("app:"), "source")).alias("tags"),
        F.when(old, i + 1).alias("superseded_by"),
        F.when(i % 10 == 1, F.array(i - 1, i + 3)).otherwise(F.array().cast("array<bigint>")).alias("evidence_ids"),
        F.when(keyed, F.concat(F.lit(" User.K"), (i % 23).cast("string"))).alias("state_key"),
        F.when(keyed, F.concat(F.lit("v"), i.cast("string"))).alias("state_value"),
        ts.alias("valid_from"),
        F.when(old, (F.lit(FIRST) - i * 1800 + 3600).cast("double")).alias("valid_to"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, embedding, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding", "label")


def query_vectors(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """The stated query set: each row whose id is divisible by ``every``."""
    return vectors(spark, sf_dir).filter(F.col("memory_id") % every == 0).select(F.col("memory_id").alias("query_id"), "embedding")
