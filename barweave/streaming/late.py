"""Late rows of a stream to a side table, none lost: on time + late + without a time = input.

The built-in watermark drops late rows unseen, so the bound is kept beside the rows here: a batch's rows are late if they are
older than the latest time of all batches before it, less the delay.  Per batch one number is read and written.  A batch that
is run again after a failure meets the same bound and overwrites its own folder, so each row is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType, TimestampType


def _seen_before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The latest time of the batches before this one; None for the first."""
    return spark.read.parquet(f"{path}/seen/batch={batch - 1}").select("seen") if batch else None


def split_batch(rows: DataFrame, batch: int, path: str, time: str, delay: str) -> None:
    """Writes one batch under path: rows/batch=N/side=..., with the bound it was held against, and seen/batch=N."""
    spark = rows.sparkSession
    before = _seen_before(spark, path, batch)
    latest = before.collect()[0]["seen"] if before is not None else None
    bound = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL '{delay}'")
    late = F.coalesce(F.col(time) < bound, F.lit(False))
    side = F.when(F.col(time).isNull(), "no_time").when(late, "late").otherwise("on_time")
    rows.select("*", bound.alias("bound"), side.alias("side")).write.mode("overwrite").partitionBy("side").parquet(f"{path}/rows/batch={batch}")
    made = spark.read.schema(rows.select(time).schema).parquet(f"{path}/rows/batch={batch}").agg(F.max(time).alias("seen"))
    made.select(F.greatest("seen", F.lit(latest).cast("timestamp")).alias("seen")).coalesce(1).write.mode("overwrite").parquet(f"{path}/seen/batch={batch}")


def route_late(stream: DataFrame, path: str, time: str = "ts", delay: str = "0 seconds") -> None:
    """Splits all that the stream has; run again over the same path, it goes on with what is new.

    stream must not have columns bound, side or batch.  Empty batches hold no rows and keep the bound.
    """
    clash = {"bound", "side", "batch"} & set(stream.columns)
    if clash:
        raise ValueError(f"columns are taken by the side table: {sorted(clash)}")
    started = stream.writeStream.foreachBatch(lambda rows, n: split_batch(rows, n, path, time, delay))
    started.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def sides(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows with bound, side and batch; schema is the stream's."""
    full = StructType(list(schema.fields)).add("bound", TimestampType()).add("batch", IntegerType()).add("side", StringType())
    return spark.read.schema(full).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
