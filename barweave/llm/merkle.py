"""Operator 12: a Merkle manifest of a dataset, by supersteps of messages between parents and children.

Leaves of a group are numbered by id; every ``fanout`` nodes in sequence have one parent.  In an upward superstep each
node sends its digest to its parent; a parent that has all of its children's hashes them and sends on.  Groups finish when
one node of theirs is left, and their nodes are the leaves of the tree over groups.  Then supersteps run in reverse: a
parent hands each child its own path and the child's siblings, so that in the end each leaf holds all it needs to be
verified by itself.

The supersteps are written as DataFrames, whose exchanges carry the same messages as an RDD's would, in the JVM: a step is
one exchange by (group, parent) of at most ``fanout`` short rows a key, so that a group that holds a third of all rows is
spread like any other.  Each step is written to the shared folder, so a lost executor repeats one step.  Leaves are numbered
by a range exchange and the counts of its partitions, never by a window over a group.  Levels with few nodes run in one
task.  Texts are hashed where they are read and never exchanged.

Every column may be null.  Null ids come first in their group, equal ids stand in order of their leaves' digests, and rows
that repeat an id are leaves of their own.  Null groups come first.  An empty table has no root and gives an empty result;
columns that are not named are neither read nor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from barweave.llm.common import read_table, stage

#: Nodes of a level that one task takes.
FEW = 2048


def encoded(columns: list[Column]) -> Column:
    """The values joined: - for null, else the number of bytes in UTF-8, a colon and the value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.concat(*parts)


def _hash(digests: Column) -> Column:
    """The digest, as bytes, of digests (bytes) as hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows, with place, their number in the group by order, and n, the group's rows."""
    dealt = stage(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    # a group is in few partitions in sequence, and here has a row in each
    spans = dealt.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    one = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(one.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col(group).alias("_group"), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(one).alias("n"))
    found = dealt.withColumn("_part", part).join(spans.withColumnRenamed("_part", "_of"), (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_of")))
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "n")


def _up(leaves: DataFrame, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """The last node of each group, and of each level the parents with their children; leaves: g, place, n, digest."""
    nodes, levels, tops = leaves.select("g", "place", "n", "digest"), [], None
    while True:
        done = nodes.where("n = 1").select("g", "digest")
        tops = done if tops is None else tops.unionByName(done)
        size = nodes.where("n > 1").count()
        if not size:
            return tops, levels
        sent = nodes.where("n > 1").select("g", F.floor(F.col("place") / fanout).alias("place"), F.ceil(F.col("n") / fanout).alias("n"), F.struct("place", "digest").alias("child"))
        sent = sent.coalesce(1) if size <= FEW else sent
        kids = F.transform(F.array_sort(F.collect_list("child")), lambda c: c["digest"])
        parents = sent.groupBy("g", "place", "n").agg(kids.alias("kids"))
        joined = F.aggregate("kids", F.lit(b""), lambda out, d: F.concat(out, d))
        nodes = stage(parents.withColumn("digest", _hash(joined)), "up")
        levels.append(nodes)


def _siblings(kids: Column, slot: Column) -> Column:
    """What stands left and right of the child in its parent, as one step of a path."""
    join = lambda part: F.aggregate(part, F.lit(b""), lambda out, d: F.concat(out, d))
    return F.struct(join(F.slice(kids, 1, slot)).alias("left"), join(F.slice(kids, slot + 2, F.size(kids))).alias("right"))


def _down(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """leaves (g, place, n and others) with path, from the leaf to the root, and subroot; tops: these two for the last node
    of each g."""
    below, paths = [leaves, *levels], None
    for k in range(len(levels), -1, -1):
        found = below[k].where("n = 1").join(tops, "g").select(*below[k].columns, "path", "subroot")
        if paths is not None:
            up = paths.select(*[F.col(c).alias(f"_{c}") for c in ("g", "place", "kids", "path", "subroot")])
            nodes = below[k].where("n > 1").withColumn("_up", F.floor(F.col("place") / fanout))
            step = nodes.join(up, (F.col("g") == F.col("_g")) & (F.col("_up") == F.col("_place")))
            here = _siblings(F.col("_kids"), (F.col("place") % fanout).cast("int"))
            found = found.unionByName(step.select(*below[k].columns, F.concat(F.array(here), "_path").alias("path"), F.col("_subroot").alias("subroot")))
        if k == 0:
            return found
        paths = stage(found.select("g", "place", "kids", "path", "subroot"), "down")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and path lead to; bytes."""
    return F.aggregate(path, digest, lambda held, step: _hash(F.concat(step["left"], held, step["right"])))


def proof(path: Column) -> Column:
    """The siblings of a path from the leaf to the root, each level's from left to right, as bytes."""
    return F.aggregate(path, F.lit(b""), lambda held, step: F.concat(held, step["left"], step["right"]))


def manifest(rows: DataFrame, group: str, order: str, columns: list[str], keep: dict[str, Column], fanout: int = 3) -> DataFrame:
    """A row a leaf: order's column as id, those of keep, digest, subroot, root (bytes) and path, an array of left and right.

    group: a column whose rows make one subtree, order: leaves stand in its order, columns: what a leaf hashes."""
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaf = F.unhex(F.sha2(encoded([F.col(c) for c in columns]).cast("binary"), 256))
    leaves = rows.select(key.alias("g"), F.col(order).alias("id"), *[c.alias(name) for name, c in keep.items()], leaf.alias("digest"))
    leaves = stage(_numbered(stage(leaves, "hashed"), "g", ["id", "digest"]), "leaves")
    tops, levels = _up(leaves, fanout)
    tops = stage(tops, "subroots")
    over = stage(_numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("id"), "digest"), "g", ["id"]), "groups")
    head, above = _up(over, fanout)
    top = head.head()
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    groups = _down(over, above, head.select("g", none.alias("path"), F.lit(None).cast("binary").alias("subroot")), fanout)
    groups = stage(groups.select(F.col("id").alias("g"), "path", F.col("digest").alias("subroot")), "group-paths")
    found = _down(leaves, levels, groups, fanout)
    return found.select("id", *keep, "digest", "subroot", F.lit(bytes(top["digest"]) if top else None).cast("binary").alias("root"), "path")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 on all documents: leaves by source and doc_id, and what verification says where some texts lost their line
    feeds.  A row without id is not tampered with."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = encoded([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns])
    tampered = F.when(hit & F.contains("text", F.lit("\n")), F.unhex(F.sha2(changed.cast("binary"), 256)))
    found = manifest(docs, "source", "doc_id", columns, {"tampered": tampered})
    found = found.withColumn("folded", fold(F.coalesce("tampered", "digest"), F.col("path")))
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias("doc_id"),
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text(proof(F.col("path"))).cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


#: The checksum of CRC-32 is made bit by bit, as DuckDB has no function for it.
OP12_SQL = """
WITH RECURSIVE
t AS (SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS row_id FROM documents),
e AS (
  SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda h, c: list_reduce(list_prepend(xor(h, c), list_transform(range(8), lambda k: k)),
             lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))) AS crc
  FROM t),
l AS (
  SELECT row_id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered
  FROM e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
lower_tree AS (
  SELECT 0 AS level, source, place, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM ranked
  UNION ALL
  SELECT level + 1, source, place // 3, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 2) // 3)
  FROM lower_tree WHERE n > 1 GROUP BY level, source, place // 3),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS rank FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, rank AS place, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 2) // 3)
  FROM upper_tree WHERE n > 1 GROUP BY level, place // 3),
lower_steps AS (
  SELECT a.source, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS rgt
  FROM lower_tree a JOIN lower_tree b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY ALL),
upper_steps AS (
  SELECT a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS rgt
  FROM upper_tree a JOIN upper_tree b ON a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY ALL),
lower_walk AS (
  SELECT row_id, source, 0 AS level, place, '' AS path, coalesce(tampered, leaf) AS h FROM ranked
  UNION ALL
  SELECT w.row_id, w.source, w.level + 1, w.place // 3, w.path || s.lft || s.rgt, sha256(s.lft || w.h || s.rgt)
  FROM lower_walk w JOIN lower_steps s ON w.source IS NOT DISTINCT FROM s.source AND w.level = s.level AND w.place = s.place),
lower_end AS (SELECT row_id, source, path, h FROM lower_walk QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY level DESC) = 1),
upper_walk AS (
  SELECT w.row_id, 0 AS level, r.rank AS place, w.path, w.h FROM lower_end w JOIN subroots r ON w.source IS NOT DISTINCT FROM r.source
  UNION ALL
  SELECT w.row_id, w.level + 1, w.place // 3, w.path || s.lft || s.rgt, sha256(s.lft || w.h || s.rgt)
  FROM upper_walk w JOIN upper_steps s ON w.level = s.level AND w.place = s.place),
ends AS (SELECT row_id, path, h FROM upper_walk QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY level DESC) = 1),
top AS (SELECT h AS root FROM upper_tree WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(ends.path) AS proof_sha256, ends.h AS folded_root, ends.h = top.root AS verified
FROM l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN ends USING (row_id) CROSS JOIN top
"""
