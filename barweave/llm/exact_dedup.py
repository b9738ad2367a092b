"""Operator 8: exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest.  A batch is reduced to one row a digest with map-side
combining; digests the index lacks are found by a sort-merge anti-join, in which the index is not shuffled, and appended with
the document that stays, and of known ones the further copies are.  Documents then meet the index on the digest; those of
a text with very many copies meet copies of its row, dealt over tasks.

A later batch never changes which document stays, and its group sizes count the batches before it.  Null text counts as
empty, null ids never win over others, rows that repeat an id share its fate (so both stay if theirs is the largest), an
empty table adds nothing.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import LOWER, UPPER, fresh_path, join_spread, lower_ascii, read_table, stage


def text_digest(text) -> F.Column:
    """SHA-256, as lower-case hex, of the text with A-Z lower-cased."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """digest, keep_id (the document that stays; null in rows of later batches) and copies (rows of the batch)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, copies BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def groups(self) -> DataFrame:
        """digest, keep_id and copies of all batches, a row a digest; buckets hold whole digests, so nothing is exchanged."""
        return self.table().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))

    def append(self, digests: DataFrame) -> None:
        """Adds rows (doc_id, digest): the largest doc_id of each digest that the index lacks stays, others are counted."""
        batch = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies"))
        batch, known = batch.repartition(self.buckets, "digest"), self.table().select("digest").hint("merge")
        new = batch.join(known, "digest", "left_anti")
        again = batch.join(known, "digest", "left_semi").withColumn("keep_id", F.lit(None).cast("bigint"))
        rows = new.unionByName(again)
        rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex, hot: int = 100_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; the index gains the texts.  Texts with over ``hot``
    copies are no one task's."""
    digests = stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest")), "digests")
    index.append(digests)
    groups = index.groups()
    return join_spread(digests, groups, "digest", groups.where(F.col("copies") > hot).select("digest")).select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 on all documents, with a new index."""
    return deduplicate(read_table(spark, sf_dir, "documents"), DigestIndex(spark, fresh_path(spark, "digests")))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
