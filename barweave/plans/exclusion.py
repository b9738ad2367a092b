"""Partial-row exclusion over pages made from the hourly bars, against manifests that are written to files and read again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.operators import closures as cl
from barweave.plans import queries as q
from barweave.sources.shared import shared_path

c = F.col
WIDTH, NOW, PAGE = "INTERVAL '1' HOUR", "2024-01-29", 50
BEGIN, END = "2024-01-01", "2024-02-01"


def _evidence(spark, d):
    """Pages: every bar as a provider's row, and where a gap starts a row of 20 minutes, with the last close.

    Declared are such rows but on every seventh day; on every fifth day by a hash that is not theirs, and on one day a closure
    that the rows know nothing of.
    """
    text = lambda name: F.round(name, 4).cast("decimal(18,4)").cast("string")
    ms = lambda t: F.unix_millis(t.cast("timestamp"))
    row = lambda t, close, *prices: F.concat(F.lit("["), ms(t).cast("string"), *[F.concat(F.lit(',"'), text(p), F.lit('"')) for p in prices], F.lit(',"'), c("volume").cast("string"), F.lit('",'), ms(close).cast("string"), F.lit("]"))
    seg = q._seg(spark, d)
    whole = seg.select("symbol", "open_time", row(c("open_time"), c("open_time") + F.expr(f"{WIDTH} - {cl.MILLI}"), "open", "high", "low", "close").alias("row"))
    last = seg.select("symbol", "close", "volume", (c("open_time") + F.expr(WIDTH)).alias("gap_start"))
    gaps = q._gaps(spark, d).withColumnRenamed("expected_open", "gap_start").join(last, ["symbol", "gap_start"])
    broke = c("gap_start") + F.expr(f"INTERVAL '20' MINUTE - {cl.MILLI}")
    gaps = gaps.withColumns({"actual_close": broke, "row": row(c("gap_start"), broke, "close", "close", "close", "close")})
    rows = whole.unionByName(gaps.select("symbol", c("gap_start").alias("open_time"), "row"))
    slot = F.floor((ms(c("open_time")) - ms(F.lit(BEGIN).cast("timestamp_ntz"))) / (3600000 * PAGE))
    grouped = rows.groupBy("symbol", slot.alias("k")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("open_time", "row"))), lambda r: r["row"]), ","), F.lit("]")).alias("body"))
    pages = grouped.select("symbol", F.row_number().over(Window.partitionBy("symbol").orderBy("k")).alias("page"), "body")
    day = F.dayofmonth("gap_start")
    declared = gaps.where(day % 7 != 0).select("symbol", "gap_start", "resumed_open", "actual_close", F.sha2(F.when(day % 5 == 0, F.concat("row", F.lit(" "))).otherwise(c("row")), 256).alias("row_sha256"))
    unknown = gaps.select("symbol").distinct().select("symbol", F.lit("2024-01-31 10:00:00").cast("timestamp_ntz").alias("gap_start"), F.lit("2024-01-31 12:00:00").cast("timestamp_ntz").alias("resumed_open"), F.lit("2024-01-31 10:20:00").cast("timestamp_ntz").alias("actual_close"), F.sha2("symbol", 256).alias("row_sha256"))
    hours = F.timestamp_diff("HOUR", "gap_start", "resumed_open").cast("bigint")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    declared = declared.unionByName(unknown).withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("gap_start"))).select(
        F.lit("1").alias("schema_version"), F.lit("events").alias("provider"), "symbol", F.lit("1h").alias("timeframe"), at(BEGIN).alias("start_time"), at(END).alias("end_time"), "place",
        F.concat_ws("-", "symbol", F.date_format("gap_start", "yyyyMMddHH")).alias("closure_id"), "gap_start", "resumed_open", hours.alias("unavailable"), (c("gap_start") + F.expr(WIDTH)).alias("missing_start"),
        (hours - 1).alias("missing"), F.lit("maintenance").alias("reason_code"), F.lit("schedule").alias("governance_reference"), c("gap_start").alias("partial_open"), "actual_close",
        (c("gap_start") + F.expr(f"{WIDTH} - {cl.MILLI}")).alias("expected_close"), "row_sha256", F.lit("partial row").alias("exclusion_reason"),
    )
    path = shared_path(spark, "manifests")
    cl.write_manifests(declared, path)
    return pages, cl.read_manifests(spark, path)


_T = lambda x: f'\'"\' || round({x}, 4)::DECIMAL(18,4)::VARCHAR || \'"\''
_ROW = lambda t, close, *p: f"'[' || epoch_ms({t})::VARCHAR || ',' || {' || chr(44) || '.join(map(_T, p))} || ',\"' || volume::VARCHAR || '\",' || epoch_ms({close})::VARCHAR || ']'"
_SQL = f"""{q._GAPS}, broken AS (SELECT g.symbol, g.expected_open AS gap_start, g.resumed_open, g.expected_open + INTERVAL '20 minutes' - INTERVAL '1 millisecond' AS actual_close, s.close, s.volume FROM gaps g JOIN seg s ON s.symbol = g.symbol AND s.open_time + INTERVAL '1 hour' = g.expected_open),
parts AS (SELECT *, {_ROW("gap_start", "actual_close", "close", "close", "close", "close")} AS row FROM broken),
provided AS (SELECT symbol, open_time, open_time + INTERVAL '1 hour' - INTERVAL '1 millisecond' AS close_time, {_ROW("open_time", "open_time + INTERVAL '1 hour' - INTERVAL '1 millisecond'", "open", "high", "low", "close")} AS row FROM seg UNION ALL SELECT symbol, gap_start, actual_close, row FROM parts),
placed AS (SELECT *, sha256(row) AS row_sha256, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS place FROM provided),
declared AS (SELECT symbol, gap_start, resumed_open, actual_close, sha256(CASE WHEN day(gap_start) % 5 = 0 THEN row || ' ' ELSE row END) AS declared_sha FROM parts WHERE day(gap_start) % 7 <> 0
 UNION ALL SELECT DISTINCT symbol, TIMESTAMP '2024-01-31 10:00:00', TIMESTAMP '2024-01-31 12:00:00', TIMESTAMP '2024-01-31 10:20:00', sha256(symbol) FROM parts),
slots AS (SELECT *, unnest(generate_series(gap_start, resumed_open, INTERVAL '1 hour')) AS open_time FROM declared),
roles AS (SELECT *, CASE open_time WHEN gap_start THEN 'partial' WHEN resumed_open THEN 'resumed' ELSE 'absent' END AS role, symbol || '-' || strftime(gap_start, '%Y%m%d%H') AS closure_id FROM slots),
met AS (SELECT symbol, open_time, place, p.row_sha256, role, closure_id, CASE WHEN p.place IS NULL THEN CASE role WHEN 'partial' THEN 'missing_partial' WHEN 'resumed' THEN 'missing_resumed' END WHEN role = 'absent' THEN 'row_in_closure'
 WHEN role = 'partial' THEN CASE WHEN p.close_time <> r.actual_close THEN 'actual_close' WHEN p.row_sha256 <> declared_sha THEN 'row_hash' WHEN p.close_time >= TIMESTAMP '{NOW}' THEN 'not_closed' END
 WHEN p.close_time <> open_time + INTERVAL '1 hour' - INTERVAL '1 millisecond' THEN 'undeclared_partial' END AS reason, p.close_time FROM placed p FULL OUTER JOIN roles r USING (symbol, open_time)),
judged AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'fault' WHEN role = 'partial' THEN 'excluded' WHEN close_time >= TIMESTAMP '{NOW}' THEN 'open' ELSE 'keep' END AS status FROM met WHERE place IS NOT NULL OR role <> 'absent')"""


@q.query("row_exclusions", f"{_SQL} SELECT symbol, open_time, coalesce(place, -1) AS place, row_sha256, closure_id, status, reason FROM judged")
def row_exclusions(spark, d):
    """Every provider row and every declared slot without one (place -1): kept, excluded, still open, or which fault."""
    pages, closures = _evidence(spark, d)
    return cl.judge(pages, closures, NOW, WIDTH).select("symbol", "open_time", F.coalesce(c("place").cast("bigint"), F.lit(-1)).alias("place"), "row_sha256", "closure_id", "status", "reason")


@q.query("exclusion_counts", f"{_SQL} SELECT symbol, status, coalesce(reason, '-') AS reason, count(*) AS n FROM judged GROUP BY ALL")
def exclusion_counts(spark, d):
    return row_exclusions(spark, d).groupBy("symbol", "status", F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count("*").alias("n"))
