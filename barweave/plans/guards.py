"""Queries of canonical candle files, series guards and sets of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators import guards
from barweave.plans import queries as q
from barweave.sources import canonical
from barweave.sources.shared import shared_path

c = F.col


def _candles(spark, d):
    price = lambda n: F.round(n, 4).cast("decimal(18,4)").alias(n)
    ends = (c("open_time") + F.expr("INTERVAL '1' HOUR - INTERVAL '0.001' SECOND")).alias("close_time")
    return q._seg(spark, d).select("symbol", F.upper("symbol").alias("base_asset"), F.lit("USD").alias("quote_asset"), F.lit("1h").alias("timeframe"), "open_time", ends, *map(price, ("open", "high", "low", "close")), c("volume").cast("decimal(18,0)").alias("volume"), F.lit(True).alias("completed"), F.lit("events").alias("source_provider"))


_P = lambda n: f"'\",\"{n}\":\"' || round({n}, 4)::DECIMAL(18,4)::VARCHAR"
_LINE = f"""'{{"symbol":"' || symbol || '","base_asset":"' || upper(symbol) || '","quote_asset":"USD","timeframe":"1h","open_time":"' || strftime(open_time, '%Y-%m-%dT%H:%M:%S.%gZ') || '","close_time":"' || strftime(open_time + INTERVAL '1 hour' - INTERVAL '1 millisecond', '%Y-%m-%dT%H:%M:%S.%gZ') || {" || ".join(map(_P, ("open", "high", "low", "close")))} || '","volume":"' || volume::VARCHAR || '","completed":true,"source_provider":"events"}}'"""


@q.query("canonical_candles", f"{q.WITH} SELECT symbol, open_time, sha256({_LINE} || chr(10)) AS line_sha256, round(close, 4)::DOUBLE AS close FROM seg")
def canonical_candles(spark, d):
    """Candles written as canonical lines, read again by the strict reader, and the lines that writing them again gives."""
    path = shared_path(spark, "candles")
    canonical.write_candles(_candles(spark, d), path)
    read = canonical.read_candles(spark, path, "events")
    lines = canonical.encode(read).select("symbol", "open_time", F.sha2(F.concat("line", F.lit("\n")), 256).alias("line_sha256"))
    return lines.join(read.select("symbol", "open_time", c("close").cast("double").alias("close")), ["symbol", "open_time"])


_FAULT = "CASE WHEN volume <= 0 OR close <= 0 THEN 'not_positive' WHEN NOT (high >= greatest(open, close) AND low <= least(open, close)) THEN 'inconsistent' ELSE 'ok' END"


@q.query("candle_guard", f"SELECT symbol, CASE WHEN k > 1 THEN 'not_chronological' ELSE {_FAULT} END AS fault, count(*) AS n FROM (SELECT event_type AS symbol, value AS open, value AS high, value AS low, value AS close, 1 AS volume, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) AS k FROM events) GROUP BY ALL")
def candle_guard(spark, d):
    """Every event as a candle of its own: which would stop the features, and why."""
    e = spark.read.parquet(f"{d}/events.parquet")
    x = e.select(c("event_type").alias("symbol"), F.lit("tick").alias("timeframe"), c("ts").alias("open_time"), *[c("value").alias(n) for n in ("open", "high", "low", "close")], F.lit(1).alias("volume"), F.lit(True).alias("completed"))
    return guards.candle_faults(x, "tick").groupBy("symbol", F.coalesce("fault", F.lit("ok")).alias("fault")).agg(F.count("*").alias("n"))


@q.query("fill_orders", "SELECT o_orderstatus AS status, count(*) AS fills, round(sum(l_quantity), 2) AS quantity, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def fill_orders(spark, d):
    """Line items as fills of orders; a fill of an unknown order would stop the query.  Fills are added up by order first."""
    fills = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("fills"), F.sum("l_quantity").alias("quantity"))
    known = guards.join_known(fills, spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return known.groupBy(c("o_orderstatus").alias("status")).agg(F.sum("fills").alias("fills"), F.round(F.sum("quantity"), 2).alias("quantity"), F.count("*").alias("orders"))


@q.query(
    "id_sets",
    "WITH a AS (SELECT l_orderkey // 2 * 2 AS id, count(*) AS uses FROM lineitem GROUP BY ALL), b AS (SELECT o_orderkey AS id, count(*) AS declarations FROM orders WHERE o_orderkey % 10 <> 4 GROUP BY ALL) "
    "SELECT CASE WHEN b.id IS NULL THEN 'unknown' WHEN declarations > 1 THEN 'repeated' WHEN a.id IS NULL THEN 'unused' ELSE 'ok' END AS status, count(*) AS ids, coalesce(sum(uses), 0)::BIGINT AS uses FROM a FULL OUTER JOIN b USING (id) GROUP BY ALL",
)
def id_sets(spark, d):
    """Orders declared (those that end in 4 are not) against orders used (odd keys use the even one below)."""
    declared = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 10 <> 4").select(c("o_orderkey").alias("id"))
    used = spark.read.parquet(f"{d}/lineitem.parquet").select(F.expr("l_orderkey - l_orderkey % 2").alias("id"))
    return guards.id_sets(declared, used, "id").groupBy("status").agg(F.count("*").alias("ids"), F.sum("uses").alias("uses"))
