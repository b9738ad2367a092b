"""Bars from a stream of events, by the definitions of the batch bars.

A bar is emitted once, when the watermark passes its end, so a bar that is not closed is never seen; repeated events
within the watermark are dropped and later ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.sources.bars import TIMEFRAMES
from barweave.sources.shared import shared_path


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream with a zoned time, as watermarks need."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    read = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files)
    return read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def closed_bars(events: DataFrame, timeframe: str, late: str = "0 seconds") -> DataFrame:
    """Append-mode bars of distinct events; each leaves the state when its slot is over."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    slot = F.window("ts", TIMEFRAMES[timeframe])
    made = once.groupBy(F.col("event_type").alias("symbol"), slot.alias("slot")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))
    return made.select("symbol", F.col("slot.start").alias("open_time"), "open", "high", "low", "close", "volume")


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Runs stream over all that is there, with its sink and checkpoint in the shared folder, and reads the sink."""
    spark = stream.sparkSession
    at = shared_path(spark, label)
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
