"""OHLCV bars from the events and lineitem tables, and klines from raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bar widths by timeframe.
TIMEFRAMES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day", "1w": "7 days"}


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    """One bar for each event type and slot: map-side combined, one exchange on (symbol, slot)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    slot = F.window("ts", TIMEFRAMES[timeframe])
    return events.groupBy(F.col("event_type").alias("symbol"), slot["start"].alias("open_time")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count("*").alias("volume"),
    )


#: Order and line as one number, nulls first: rows compared by a struct would be sorted to be aggregated, numbers are hashed.
_LINE = """coalesce(cast(l_orderkey as decimal(20,0)), -9223372036854775809BD) * 8589934592BD
  + coalesce(cast(l_linenumber as decimal(10,0)), -2147483649BD)"""


def item_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices for each return flag, ordered in a day by order and line."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    at, price = F.expr(_LINE), F.col("l_extendedprice") / F.col("l_quantity")
    return items.groupBy(F.col("l_returnflag").alias("symbol"), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("open_time")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def segmented(bars: DataFrame, width: str = "INTERVAL '1' HOUR") -> DataFrame:
    """bars with candle_index (place in the symbol's series), segment (run without a missing slot) and local_index."""
    series = Window.partitionBy("symbol").orderBy("open_time")
    starts = F.coalesce(F.lag("open_time").over(series) + F.expr(width) != F.col("open_time"), F.lit(False)).cast("int")
    indexed = bars.withColumns({"candle_index": (F.row_number().over(series) - 1).cast("bigint"), "_new": starts})
    run = indexed.withColumn("segment", F.sum("_new").over(series.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")
    return run.withColumn("local_index", (F.row_number().over(Window.partitionBy("symbol", "segment").orderBy("open_time")) - 1).cast("bigint"))


def klines(pages: DataFrame, symbol: str) -> DataFrame:
    """Candles of kline pages (body: a JSON array of arrays): open ms, OHLC and volume as exact decimals, close ms.

    Further fields are ignored; a row of under seven fields or with a price that is no number fails the query.
    """
    rows = pages.select(F.explode(F.from_json("body", "array<array<string>>")).alias("k"))
    checked = rows.select(F.when(F.size("k") >= 7, F.col("k")).otherwise(F.raise_error(F.lit("a kline needs seven fields"))).alias("k"))
    number = lambda i: F.expr(f"cast(k[{i}] as decimal(38,18))")
    names = ("open", "high", "low", "close", "volume")
    return checked.select(
        F.lit(symbol).alias("symbol"),
        F.timestamp_millis(F.col("k")[0].cast("bigint")).alias("open_time"),
        *[number(i + 1).alias(n) for i, n in enumerate(names)],
        F.timestamp_millis(F.col("k")[6].cast("bigint")).alias("close_time"),
    )


def completed(bars: DataFrame, server_time: str, width: str = "INTERVAL '1' HOUR") -> DataFrame:
    """Bars whose close, the last millisecond of their slot, lies before server_time."""
    close = F.col("open_time") + F.expr(width) - F.expr("INTERVAL '0.001' SECOND")
    return bars.withColumn("close_time", close).where(F.col("close_time") < F.lit(server_time).cast("timestamp_ntz"))


def event_bars_sql(width: str) -> str:
    return f"""SELECT event_type AS symbol, time_bucket(INTERVAL '{width}', ts) AS open_time, arg_min(value, ts) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY ALL"""


ITEM_BARS_SQL = """SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS open_time,
       arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice / l_quantity) AS high,
       min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS close,
       sum(l_quantity) AS volume FROM lineitem GROUP BY ALL"""

#: Hourly bars with candle_index, segment and local_index.
SEGMENTED_SQL = f"""bars AS ({event_bars_sql("1 hour")}),
flagged AS (SELECT *, row_number() OVER s - 1 AS candle_index, coalesce(lag(open_time) OVER s + INTERVAL '1 hour' <> open_time, false)::INT AS fresh
            FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY open_time)),
runs AS (SELECT * EXCLUDE fresh, sum(fresh) OVER (PARTITION BY symbol ORDER BY open_time)::BIGINT AS segment FROM flagged),
seg AS (SELECT *, row_number() OVER (PARTITION BY symbol, segment ORDER BY open_time) - 1 AS local_index FROM runs)"""
