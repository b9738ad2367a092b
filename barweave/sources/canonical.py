"""Candles as canonical JSON lines: compact, fields in a fixed order, decimals as text, times in UTC milliseconds.

Numbers stay texts with the places they were written with, so that writing what was read gives the same bytes.  All of it
runs in the JVM: a line is its struct's JSON, and a line is canonical if its own values encode to it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["symbol", "base_asset", "quote_asset", "timeframe", "open_time", "close_time", "open", "high", "low", "close", "volume", "completed", "source_provider"]
NUMBERS = ["open", "high", "low", "close", "volume"]
SCHEMA = ", ".join(f"{f} {'boolean' if f == 'completed' else 'string'}" for f in FIELDS)
NUMBER = r"^-?[0-9]+([.][0-9]+)?$"
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _line(fields: dict):
    return F.to_json(F.struct(*[fields[f].alias(f) for f in FIELDS]), {"ignoreNullFields": "false"})


def encode(candles: DataFrame) -> DataFrame:
    """(symbol, open_time, line) of candles; other columns are left out.

    Prices and volume are decimals or texts in plain notation.  A candle that is not completed, a null or a number in another
    notation is an error that names it.
    """
    stop = lambda why: F.raise_error(F.concat_ws(" ", F.lit(why), "symbol", F.col("open_time").cast("string")))
    made = {f: F.col(f).cast("string") for f in FIELDS if f != "completed"} | {t: F.date_format(t, _STAMP) for t in ("open_time", "close_time")}
    whole = F.array_contains(F.array(*[v.isNull() for v in made.values()]), True)
    plain = F.coalesce(F.array_contains(F.array(*[made[n].rlike(NUMBER) for n in NUMBERS]), False), F.lit(True))
    made["completed"] = F.when(~F.coalesce("completed", F.lit(False)), stop("candle is not completed:").cast("boolean")).when(whole, stop("candle lacks a value:").cast("boolean")).when(plain, stop("number is not plain:").cast("boolean")).otherwise(True)
    return candles.select("symbol", "open_time", _line(made).alias("line"))


def write_candles(candles: DataFrame, path: str) -> None:
    """Candles as text files whose lines, files taken by name, ascend by symbol and time; split by ranges of both, so that a
    long series is many files."""
    encode(candles).repartitionByRange("symbol", "open_time").sortWithinPartitions("symbol", "open_time", "line").select(F.col("line").alias("value")).write.text(path)


def scan(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """The lines under path with their fields, times as timestamps, and fault: null or the first of not_json, not_canonical
    (other fields, order, spaces or notation), not_completed, other_provider.  A line's end is not seen by the reader."""
    x = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    x = x.withColumn("c", F.from_json("line", SCHEMA))
    time = lambda name: F.try_to_timestamp(F.rtrim(F.translate(f"c.{name}", "TZ", "  ")), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).cast("timestamp_ntz")
    again = {f: F.col(f"c.{f}") for f in FIELDS} | {t: F.date_format(time(t), _STAMP) for t in ("open_time", "close_time")}
    plain = F.forall(F.array(*[F.col(f"c.{n}") for n in NUMBERS]), lambda n: F.coalesce(n.rlike(NUMBER), F.lit(False)))
    named = F.forall(F.array(*[F.col(f"c.{n}") for n in FIELDS if n != "completed"]), lambda n: n.isNotNull())
    same = F.coalesce((_line(again) == F.col("line")) & plain & named, F.lit(False))
    fault = F.when(F.col("c").isNull() | F.forall(F.array(*[F.col(f"c.{f}").isNull() for f in FIELDS]), lambda n: n), "not_json").when(~same, "not_canonical").when(~F.col("c.completed"), "not_completed").when(F.col("c.source_provider") != provider, "other_provider")
    return x.select("file", "line", *[time(f).alias(f) if f.endswith("_time") else F.col(f"c.{f}").alias(f) for f in FIELDS], fault.alias("fault"))


def read_candles(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Candles of canonical files; the first line with a fault stops the job with its file, fault and text."""
    told = F.concat_ws(" ", F.lit("line fault:"), "fault", "file", F.left("line", F.lit(200)))
    x = scan(spark, path, provider)
    return x.where(F.when(F.col("fault").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True)).select(*FIELDS)
