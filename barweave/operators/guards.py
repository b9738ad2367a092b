"""Guards that a whole input must pass: series of candles before features, and sets of ids against one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candle_faults(candles: DataFrame, timeframe: str) -> DataFrame:
    """candles (symbol, timeframe, open_time, open, high, low, close, volume, completed) with fault, null if all is well.

    The first that applies: not_completed (null too), other_timeframe, not_chronological (an open time of the symbol again),
    not_finite (null too), not_positive (close and volume), inconsistent (high below or low above open or close).  That open
    times repeat is seen in the window by symbol and time that features sort by anyway: no further exchange.
    """
    again = F.lag("open_time").over(Window.partitionBy("symbol").orderBy("open_time")) == F.col("open_time")
    v = [F.col(n).cast("double") for n in ("open", "high", "low", "close", "volume")]
    finite = F.forall(F.array(*v), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    o, h, low, cl, vol = v
    fault = (
        F.when(~F.coalesce("completed", F.lit(False)), "not_completed").when(~F.col("timeframe").eqNullSafe(F.lit(timeframe)), "other_timeframe")
        .when(again | F.col("open_time").isNull(), "not_chronological").when(~finite, "not_finite").when((cl <= 0) | (vol <= 0), "not_positive").when((h < F.greatest(o, cl)) | (low > F.least(o, cl)), "inconsistent")
    )
    return candles.withColumn("fault", fault)


def guarded(candles: DataFrame, timeframe: str) -> DataFrame:
    """candles, of which any fault stops the job that reads them: nothing is committed of a series that is not sound."""
    told = F.concat_ws(" ", F.lit("candle fault:"), "fault", "symbol", F.col("open_time").cast("string"))
    x = candle_faults(candles, timeframe)
    return x.where(F.when(F.col("fault").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True)).drop("fault")


def id_sets(declared: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """A row an id of either side: declarations and uses (counts), and status: ok, unknown (used, never declared), unused or
    repeated (declared more than once).  Both are counted by id before they meet, so a hot id is one row of each side; null ids
    are one id."""
    side = lambda rows, name: rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name)).withColumn("_null", F.col("id").isNull())
    a, b = side(declared, "declarations"), side(used, "uses")
    met = a.alias("a").join(b.alias("b"), F.expr("a.id <=> b.id AND a._null = b._null"), "full_outer")
    x = met.select(F.coalesce("a.id", "b.id").alias(key), F.coalesce("declarations", F.lit(0)).alias("declarations"), F.coalesce("uses", F.lit(0)).alias("uses"))
    return x.withColumn("status", F.when(F.col("declarations") == 0, "unknown").when(F.col("declarations") > 1, "repeated").when(F.col("uses") == 0, "unused").otherwise("ok"))


def join_known(used: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """used with its declaration's columns; a use of an id that nothing declares stops the job.

    Ids declared twice give a row each: id_sets tells them."""
    marked = declared.withColumn("_known", F.lit(True))
    told = F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    x = used.join(marked, key, "left")
    return x.where(F.coalesce("_known", F.raise_error(told).cast("boolean"))).drop("_known")
