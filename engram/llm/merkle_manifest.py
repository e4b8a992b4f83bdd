"""Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over the groups, and a proof for each row.

Leaves are numbered in order: range partitions over (group, id, leaf), row_number within each partition, and the partitions' sizes
before it; so no group is ordered in one task, however large. Level by level, floor-division by the fanout
gathers a run's children (at most ``fanout``), sorted, and hashes them into their parent. The proofs go the other way: from the root down, one join
for each level hands a parent's path, with the siblings found there, to its children. All levels above the leaves together have half as
many nodes as there are leaves (at fanout 3), so all joins together move about 1.5 rows for each leaf; appending from the leaves upwards would
move every leaf at every level. Each level's nodes are a written table, as are the paths at every fourth level. The driver holds one number for each range partition.

Defined results: a null field is hashed as "-", so it differs from an empty text; null groups come first, null ids come first in their group, and a
null id counts as empty text where its crc32 is asked for; rows that share group and id are ordered by leaf; rows that repeat entirely
have the same leaf at neighbouring places, each with the proof of its place. A single leaf is its group's subroot, a single subroot the root, and where a
path has no siblings the proof is the digest of nothing. An empty table gives no rows. Texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shielded, table

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """"-" for null, else length in bytes, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``part`` (range partition) and ``at``, the row's place from 0 in ascending order of the columns, nulls first."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes, before = sorted(dealt.groupBy("part").count().collect()), []
    for part, size in sizes:  # one number for each partition
        before.append((part, before[-1][1] + before[-1][2] if before else 0, size))
    starts = F.broadcast(spark.createDataFrame(before, "part int, start long, size long").select("part", "start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")
    return dealt.withColumn("place", place).join(starts, "part").withColumn("at", F.col("start") + F.col("place") - 1).drop("start", "place")


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """From (grp, idx, n, hash), n being the number of nodes of grp, the tables (grp, idx, n, hash, kids) of all levels above."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    found, nodes = [], leaves
    while most > 1:
        runs = nodes.filter("n > 1").groupBy("grp", F.floor(F.col("idx") / fanout).alias("up")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("kids"))
        kids = F.col("kids.hash")
        found.append(cut(runs.select("grp", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.concat_ws("", kids), 256).alias("hash"), kids.alias("kids"))))
        nodes, most = found[-1], -(-most // fanout)
    return found


def roots(leaves: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(grp, root): the node that remains of each group."""
    out = leaves.filter("n = 1").select("grp", F.col("hash").alias("root"))
    for level in above:
        out = out.unionByName(level.filter("n = 1").select("grp", F.col("hash").alias("root")))
    return out


def paths(leaves: DataFrame, above: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, idx, carried columns of ``tops``, path) of all leaves. ``tops`` has grp, path and further columns for each group; a path is an array of
    (before, after), the siblings to the left and right at each level from the leaf up."""
    carried = [c for c in tops.columns if c not in ("grp", "path")]
    found = None
    for k, level in enumerate([*reversed(above), leaves], 1):
        single = level.filter("n = 1").select("grp", "idx").join(tops, "grp")
        found = single if found is None else found.unionByName(single)
        if level is not leaves:
            met = level.select("grp", "idx", "kids").join(found, ["grp", "idx"]).select("grp", "idx", "path", *carried, "kids", F.posexplode("kids").alias("k", "kid"))
            before, after = F.array_join(F.slice("kids", 1, F.col("k")), ""), F.array_join(F.slice("kids", F.col("k") + 2, fanout), "")
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            found = met.select("grp", (F.col("idx") * fanout + F.col("k")).alias("idx"), F.concat(step, "path").alias("path"), *carried)
            found = found if k % 4 else cut(found)
    return found


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, *, fields: list[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, and the columns of ``carry``, given in the columns of ``rows``) for each row."""
    carry = carry or {}
    rows, new, _ = shielded(rows.withColumns(carry) if carry else rows)
    digests = rows.select(F.col(new[group_col]).alias("group"), F.col(new[id_col]).alias("id"), leaf([F.col(new[f]) for f in fields]).alias("leaf"), *(F.col(new[c]).alias(f"carry_{i}") for i, c in enumerate(carry)))
    # Rows that repeat entirely are told apart by their place in the written table, so that they too are dealt out.
    placed = cut(numbered(cut(digests).withColumn("copy", F.monotonically_increasing_id()), "group", "id", "leaf", "copy"))
    # One row for each partition and group: the join below then splits a large group as the partitions do.
    spans = placed.groupBy("part", "group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    groups = spans.groupBy("group").agg(F.min("first").alias("grp"), F.sum("rows").alias("n"))
    spans = spans.select("part", F.col("group").alias("g")).join(groups, F.col("g").eqNullSafe(F.col("group"))).select(F.col("part").alias("p"), "g", "grp", "n")
    met = placed.join(spans, (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g")))
    leaves = cut(met.select("grp", (F.col("at") - F.col("grp")).alias("idx"), "n", F.col("leaf").alias("hash"), "id", *(f"carry_{i}" for i in range(len(carry)))))
    above = levels(leaves, fanout)
    subroots = cut(roots(leaves, above))
    # A group's number is its first row's place, so groups are in the order of their numbers.
    top = cut(numbered(subroots, "grp").select(F.lit(0).cast("long").alias("grp"), F.col("at").alias("idx"), F.col("root").alias("hash"), F.col("grp").alias("of"), F.lit(subroots.count()).cast("long").alias("n")))
    top_above = levels(top, fanout)
    none = F.array().cast("array<struct<before:string,after:string>>")
    start = roots(top, top_above).select("grp", "root", none.alias("path"))
    tops = cut(top.select("idx", F.col("of"), F.col("hash").alias("subroot")).join(paths(top, top_above, start, fanout).drop("grp"), "idx").select(F.col("of").alias("grp"), "subroot", "root", "path"))
    out = leaves.withColumnRenamed("hash", "leaf").join(paths(leaves.withColumnRenamed("hash", "leaf"), above, tops, fanout), ["grp", "idx"])
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "path", *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document with its proof, folded from its text, or from a text without line feeds where the id's crc32 is even."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = manifest(docs, carry={"told": leaf([text if f == "text" else F.col(f) for f in FIELDS])})
    out = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.col("told")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
with recursive r as (
  select *, row_number() over (partition by source order by doc_id) - 1 as idx, count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as s,
    concat(case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end, case when source is null then '-' else strlen(source) || ':' || source end,
      case when lang is null then '-' else strlen(lang) || ':' || lang end, case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end) as head,
    replace(text, chr(10), '') as short,
    list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1)))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) as inverted
  from documents),
l as (
  select doc_id, s, idx, n, sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
    case when inverted % 2 = 1 then sha256(head || case when text is null then '-' else strlen(short) || ':' || short end) end as cut from r),
t as (
  select 0 as k, s, idx, n, leaf as h from l
  union all select k + 1, s, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from t where n > 1 group by k, s, idx // 3, n),
subs as (select s, h, count(*) over () as n from t where n = 1),
u as (
  select 0 as k, s as idx, n, h from subs
  union all select k + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from u where n > 1 group by k, idx // 3, n),
sides as (
  select k, s, idx, concat(lag(h, 2) over w, lag(h) over w) as l, concat(lead(h) over w, lead(h, 2) over w) as r from t where n > 1 window w as (partition by k, s, idx // 3 order by idx)
  union all select 1000 + k, -1, idx, concat(lag(h, 2) over w, lag(h) over w), concat(lead(h) over w, lead(h, 2) over w) from u where n > 1 window w as (partition by k, idx // 3 order by idx)),
p as (
  select l.s, l.idx, list({'l': sides.l, 'r': sides.r} order by sides.k) filter (sides.k is not null) as path
  from l left join sides on (sides.k < 1000 and sides.s = l.s and sides.idx = l.idx // (3 ** sides.k)::bigint) or (sides.k >= 1000 and sides.idx = l.s // (3 ** (sides.k - 1000))::bigint)
  group by all),
f as (
  select l.doc_id, l.leaf, subs.h as subroot, (select h from u where n = 1) as root, coalesce(p.path, []) as path, coalesce(l.cut, l.leaf) as told
  from l join subs using (s) join p on p.s = l.s and p.idx = l.idx)
select doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(path, lambda x: x.l || x.r)), 'string_agg', '')) as proof_sha256,
  list_reduce(list_concat([{'l': told, 'r': ''}], path), lambda a, b: {'l': sha256(b.l || a.l || b.r), 'r': ''}).l as folded_root, folded_root = root as verified from f
"""
