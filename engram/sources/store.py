"""Versioned Parquet libraries with an optimistic pointer, and the import and export formats."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("memory_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("response", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("ts", T.DoubleType()), T.StructField("last_accessed", T.DoubleType()),
    T.StructField("access_count", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("source", T.StringType()),
    T.StructField("superseded_by", T.LongType()), T.StructField("evidence_ids", T.ArrayType(T.LongType())), T.StructField("updated_at", T.DoubleType()),
    T.StructField("valid_from", T.DoubleType()), T.StructField("valid_to", T.DoubleType()), T.StructField("state_key", T.StringType()), T.StructField("state_value", T.StringType()),
])
DEFAULTS = {"source": "'auto'", "access_count": "0L", "response": "''", "tags": "cast(array() as array<string>)", "evidence_ids": "cast(array() as array<bigint>)"}


def conform(df: DataFrame) -> DataFrame:
    """Any earlier layout as the current one: missing columns null or defaulted, null lists empty."""
    have = set(df.columns)
    cols = []
    for f in ENTRY.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name == "last_accessed" and "ts" in have:
            c = F.coalesce(c, F.col("ts").cast("double"))
        cols.append((F.coalesce(c, F.expr(DEFAULTS[f.name])) if f.name in DEFAULTS else c).alias(f.name))
    return df.select(*cols)


class Library:
    """Snapshots under ``path``; the newest numbered pointer names the current one. A writer whose base is no longer current, or
    who comes second with the next pointer, gets a conflict snapshot. Pointers are renamed into place and never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        p = self._hadoop.Path(f"{self.path}/{name}")
        return p.getFileSystem(self._conf), p

    def _newest(self) -> tuple[int, str | None]:
        """Number and version of the newest pointer; (0, None) if there is none."""
        fs, folder = self._at("pointers")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        return number, self.spark.read.text(f"{folder}/{number:010d}").first()[0] if number else None

    def _publish(self, number: int, version: str) -> bool:
        """Whether ``version`` became the current one, as pointer ``number``; not if another writer has placed that pointer."""
        fs, made = self._at(f"pointers/.{version}")
        out = fs.create(made, False)
        out.write(bytearray(version.encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(made.toUri(), self._conf).rename(made, self._at(f"pointers/{number:010d}")[1], plain)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            fs.delete(made, False)
            return False
        return True

    def current(self) -> str | None:
        return self._newest()[1]

    def load(self, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(self.path)
        return conform(self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{version}"))

    def save(self, entries: DataFrame, base: str | None = None) -> tuple[str, bool]:
        """(version, is current). ``base``: the version the entries came from."""
        number, now = self._newest()
        name = uuid.uuid4().hex
        fresh = base == now
        version = ("v-" if fresh else "conflict-") + name
        conform(entries).write.parquet(f"{self.path}/{version}")
        if fresh and not self._publish(number + 1, version):
            fs, written = self._at(version)
            fresh, version = False, f"conflict-{name}"
            if not fs.rename(written, self._at(version)[1]):
                raise OSError(f"{written} could not be renamed")
        return version, fresh


def export_facts(entries: DataFrame) -> DataFrame:
    """Every column but the embedding, lists as JSON text."""
    out = entries.drop("embedding")
    return out.select(*(F.to_json(c).alias(c) if isinstance(out.schema[c].dataType, T.ArrayType) else F.col(c) for c in out.columns))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of Markdown files, without index pages and front matter."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("name"))
    return df.filter("name <> 'index'").select("name", F.trim(F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")).alias("text"))


def trajectories(df: DataFrame) -> DataFrame:
    """Nested trajectories (id, states[]) to one text per state: address, thought, action and a short page tree."""
    s = df.select("id", F.posexplode("states").alias("pos", "s"))
    tree = F.when(F.length("s.accessibility_tree") < 1500, F.col("s.accessibility_tree"))
    return s.select("id", "pos", F.concat_ws("\n", "s.url", "s.thought", "s.action", tree).alias("text")).filter("text <> ''")


TURNS = "conversation map<string, array<struct<speaker: string, text: string>>>"


def dialogues(df: DataFrame) -> DataFrame:
    """(id, json) conversations of named sessions to one row per turn: (id, session, pos, speaker, text)."""
    parsed = df.select("id", F.from_json("json", TURNS).alias("c"))
    turns = parsed.select("id", F.explode("c.conversation").alias("session", "turns")).select("id", "session", F.posexplode("turns").alias("pos", "t"))
    return turns.select("id", "session", "pos", "t.speaker", "t.text")
