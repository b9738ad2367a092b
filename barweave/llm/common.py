"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of the six ASCII white-space characters, which separate words.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests) and all runs on this machine,
    one of our own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(taken: list[str], name: str) -> str:
    """name, or with underscores before it until no column is called so, whatever the case of its letters."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def split_by(rows: DataFrame, key: str, keys: DataFrame, log_bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """rows whose ``key`` is surely none of those in ``keys`` (one column, not null), and all others.

    keys become a bitmap of at most 2**log_bits bits (8 MB), whatever their number, which is broadcast.  The more keys, the
    more rows may hold one; so this spares exchanges of rows and decides nothing: those that may hold a key are joined."""
    at, part, bit, maps = (unused([*rows.columns, *keys.columns], n) for n in ("at", "part", "bit", "map"))
    place = lambda name: F.pmod(F.xxhash64(F.col(f"`{name}`")), F.lit(1 << log_bits))
    parts = keys.select(place(keys.columns[0]).alias(at)).select(F.shiftright(at, 15).alias(part), F.col(at).bitwiseAND(32767).alias(bit))
    # at most 2**(log_bits - 15) rows of 4 KB each
    table = stage(parts.groupBy(part).agg(F.bitmap_construct_agg(bit).alias(maps)), "bitmap")
    joined = rows.withColumn(at, place(key)).join(F.broadcast(table), F.shiftright(at, 15) == F.col(part), "left")
    byte = f"cast(conv(hex(substring({maps}, cast(shiftright({at} & 32767, 3) + 1 as int), 1)), 16, 10) as int)"
    held = F.expr(f"coalesce(bit_get({byte}, cast({at} & 7 as int)) = 1, false)")
    return joined.where(~held).drop(at, part, maps), joined.where(held).drop(at, part, maps)


def join_spread(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, parts: int = 32) -> DataFrame:
    """rows with the columns of table, whose key is unique, by a left join on the key.

    hot: the keys that very many rows hold.  Rows that may hold one meet copies of the table's rows, dealt over parts, so that
    a key's rows are no one task's."""
    part = unused([*rows.columns, *table.columns], "part")
    hot = stage(hot, "hot")
    rest, many = split_by(rows, key, hot)
    one, copied = split_by(table, key, hot)
    many = many.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    copied = copied.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rest.join(one, key, "left").unionByName(many.join(copied, [key, part], "left").drop(part))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)
