"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, source mixing and best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is written
as Parquet and read again; all but the last return the columns of documents.  Stages keep columns they do not know, and
null, empty, repeated and very long rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import stage
from barweave.llm.mixing import mix_documents
from barweave.llm.packing import pack_documents
from barweave.llm.quality import quality_filter
from barweave.llm.simhash import drop_near_duplicates
from barweave.llm.templates import drop_recurring_lines
from barweave.llm.tokenise import SMALL, vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distribution test reject go."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows the text."""
    cleaned = drop_recurring_lines(docs, count=None)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 1024 tokens; executors are full from the stages before."""
    return pack_documents(docs, vocabulary_path("byte_bpe_50k.json"), cache=SMALL)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Tokenising, fingerprints and packing are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
