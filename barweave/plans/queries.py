"""Registered queries of the research engine and, beside each, the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.functions import features as ft
from barweave.functions.rounding import rounded
from barweave.operators import sequential, specialists
from barweave.sources import bars as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.segmented(b.event_bars(spark, sf_dir, "1h"))


def _r(col, places: int = 8):
    return rounded(col, places)


WITH = f"WITH {b.SEGMENTED_SQL}"
BASE = f"{WITH}, {ft.base_sql()}"
S = lambda: Window.partitionBy("symbol").orderBy("candle_index")
WIN = "WINDOW s AS (PARTITION BY symbol ORDER BY candle_index)"

# Bars -----------------------------------------------------------------------------------------------------------
for _name, _tf, _width in (("ev_bars_15m", "15m", "15 minutes"), ("ev_bars_1h", "1h", "1 hour"), ("ev_bars_4h", "4h", "4 hours"), ("ev_bars_1d", "1d", "1 day")):
    query(_name, b.event_bars_sql(_width))(lambda spark, d, tf=_tf: b.event_bars(spark, d, tf))


@query("li_bars_1d", f"SELECT symbol, open_time, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM ({b.ITEM_BARS_SQL})")
def li_bars_1d(spark, d):
    return b.item_bars(spark, d).select("symbol", "open_time", *[_r(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("completed_bars_only", f"{WITH} SELECT symbol, open_time, close, open_time + INTERVAL '1 hour' - INTERVAL '1 millisecond' AS close_time FROM bars WHERE open_time + INTERVAL '1 hour' - INTERVAL '1 millisecond' < TIMESTAMP '2024-01-15 00:00:00'")
def completed_bars_only(spark, d):
    return b.completed(b.event_bars(spark, d, "1h"), "2024-01-15 00:00:00").select("symbol", "open_time", "close", "close_time")


@query(
    "bar_quality_violations",
    """WITH x AS (SELECT event_type AS symbol, value + 1 AS open, CASE WHEN event_id % 89 = 0 THEN value ELSE value + 3 END AS high, value AS low,
 CASE WHEN event_id % 97 = 0 THEN 0 ELSE value + 2 END AS close, CASE WHEN event_id % 83 = 0 THEN -1 ELSE 1 END AS volume FROM events)
SELECT symbol, reason, count(*) AS n FROM (SELECT symbol, CASE WHEN least(open, high, low, close) <= 0 THEN 'nonpositive_price' WHEN volume < 0 THEN 'negative_volume'
 WHEN NOT (low <= open AND open <= high) THEN 'open_outside_range' WHEN NOT (low <= close AND close <= high) THEN 'close_outside_range' ELSE 'ok' END AS reason FROM x) GROUP BY ALL""",
)
def bar_quality_violations(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value")
    v, i = F.col("value"), F.col("event_id")
    x = e.select(F.col("event_type").alias("symbol"), (v + 1).alias("open"), F.when(i % 89 == 0, v).otherwise(v + 3).alias("high"), v.alias("low"), F.when(i % 97 == 0, 0.0).otherwise(v + 2).alias("close"), F.when(i % 83 == 0, -1).otherwise(1).alias("volume"))
    reason = (
        F.when(F.least("open", "high", "low", "close") <= 0, "nonpositive_price").when(F.col("volume") < 0, "negative_volume")
        .when(~F.col("open").between(F.col("low"), F.col("high")), "open_outside_range").when(~F.col("close").between(F.col("low"), F.col("high")), "close_outside_range").otherwise("ok")
    )
    return x.groupBy("symbol", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("bars_of_many_events", """SELECT symbol, sum((n > 1)::INT)::BIGINT AS duplicated, max(n) AS most FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS t, count(*) AS n FROM events GROUP BY ALL) GROUP BY symbol""")
def bars_of_many_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts")).agg(F.count("*").alias("n"))
    return n.groupBy("symbol").agg(F.sum((F.col("n") > 1).cast("bigint")).alias("duplicated"), F.max("n").alias("most"))


# Segments -------------------------------------------------------------------------------------------------------
@query("segments", f"{WITH} SELECT symbol, open_time, candle_index, segment, local_index FROM seg")
def segments(spark, d):
    return _seg(spark, d).select("symbol", "open_time", "candle_index", "segment", "local_index")


@query("segment_summary", f"{WITH} SELECT symbol, segment, min(open_time) AS first_open, max(open_time) AS last_open, count(*) AS n, min(candle_index) AS start_index, max(candle_index) + 1 AS end_index FROM seg GROUP BY ALL")
def segment_summary(spark, d):
    return _seg(spark, d).groupBy("symbol", "segment").agg(F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"), F.count("*").alias("n"), F.min("candle_index").alias("start_index"), (F.max("candle_index") + 1).alias("end_index"))


_GAPS = f"{WITH}, gaps AS (SELECT symbol, lag(open_time) OVER s + INTERVAL '1 hour' AS expected_open, open_time AS resumed_open FROM seg {WIN} QUALIFY expected_open <> resumed_open)"


def _gaps(spark, d):
    expected = F.lag("open_time").over(S()) + F.expr("INTERVAL '1' HOUR")
    return _seg(spark, d).select("symbol", expected.alias("expected_open"), F.col("open_time").alias("resumed_open")).where("expected_open <> resumed_open")


@query("gap_report", f"{_GAPS} SELECT *, date_diff('hour', expected_open, resumed_open) AS missing FROM gaps")
def gap_report(spark, d):
    return _gaps(spark, d).withColumn("missing", F.timestamp_diff("HOUR", "expected_open", "resumed_open").cast("bigint"))


@query("missing_slots", f"{_GAPS} SELECT symbol, unnest(generate_series(expected_open, resumed_open - INTERVAL '1 hour', INTERVAL '1 hour')) AS slot FROM gaps")
def missing_slots(spark, d):
    return _gaps(spark, d).select("symbol", F.explode(F.sequence("expected_open", F.col("resumed_open") - F.expr("INTERVAL '1' HOUR"), F.expr("INTERVAL '1' HOUR"))).alias("slot"))


@query("closure_match", f"{_GAPS}, closures AS (SELECT DISTINCT expected_open, resumed_open FROM gaps WHERE hour(expected_open) % 2 = 0) SELECT g.symbol, g.expected_open, g.resumed_open, c.expected_open IS NOT NULL AS declared FROM gaps g LEFT JOIN closures c USING (expected_open, resumed_open)")
def closure_match(spark, d):
    gaps = _gaps(spark, d)
    closures = gaps.where(F.hour("expected_open") % 2 == 0).select("expected_open", "resumed_open").distinct().withColumn("declared", F.lit(True))
    return gaps.join(closures, ["expected_open", "resumed_open"], "left").select("symbol", "expected_open", "resumed_open", F.coalesce("declared", F.lit(False)).alias("declared"))


# Features -------------------------------------------------------------------------------------------------------
def _family(names: list[str]):
    def run(spark, d):
        made = ft.registry()
        raw = ft.base(_seg(spark, d)).select("symbol", "candle_index", *[made[n].alias(n) for n in names])
        return raw.select("symbol", "candle_index", *[_r(F.col(n)).alias(n) for n in names])

    return run


def _family_sql(names: list[str]) -> str:
    made = ft.registry_sql()
    return f"{BASE} SELECT symbol, candle_index, {', '.join(f'round({made[n]}, 8) AS {n}' for n in names)} FROM base"


for _f in ft.FAMILIES:
    query(f"feat_{_f}", _family_sql(ft.names_of(_f)))(_family(ft.names_of(_f)))

ALL = list(ft.registry_sql())


@query("feature_matrix_complete", f"{BASE}, m AS ({_family_sql(ALL).split(BASE)[1]}) SELECT * FROM m WHERE {' AND '.join(f'{n} IS NOT NULL' for n in ALL)}")
def feature_matrix_complete(spark, d):
    return _family(ALL)(spark, d).dropna(subset=ALL)


# Labels and regimes ---------------------------------------------------------------------------------------------
# Exact tick rounding needs decimals; taker 10, half spread 5 and slippage 10 basis points, tick 0.01.
_LAB = f"""{WITH}, lab AS (SELECT symbol, candle_index, lead(open, 1) OVER w AS entry_open, lead(open, 4) OVER w AS exit_open FROM seg
 WINDOW w AS (PARTITION BY symbol, segment ORDER BY open_time)),
fill AS (SELECT *, ceil(entry_open::DECIMAL(18,6) * 1.0015 * 100) / 100 AS entry_fill, floor(exit_open::DECIMAL(18,6) * 0.9985 * 100) / 100 AS exit_fill FROM lab WHERE exit_open IS NOT NULL AND entry_open > 0 AND exit_open > 0),
net AS (SELECT *, (exit_fill * 0.999 - entry_fill * 1.001) / nullif(entry_fill * 1.001, 0) AS net_return, exit_open / entry_open - 1 AS gross_return FROM (SELECT symbol, candle_index, entry_open, exit_open, entry_fill::DOUBLE AS entry_fill, exit_fill::DOUBLE AS exit_fill FROM fill))"""
HURDLE = 0.006


def _labels(spark, d, seg=None):
    w = ft.series()
    lab = (_seg(spark, d) if seg is None else seg).select("symbol", "candle_index", F.lead("open", 1).over(w).alias("entry_open"), F.lead("open", 4).over(w).alias("exit_open")).where("exit_open IS NOT NULL AND entry_open > 0 AND exit_open > 0")
    fills = lab.withColumns({
        "entry_fill": F.expr("cast(ceil(cast(entry_open as decimal(18,6)) * 1.0015BD * 100BD) as double) / 100"),
        "exit_fill": F.expr("cast(floor(cast(exit_open as decimal(18,6)) * 0.9985BD * 100BD) as double) / 100"),
    })
    cost = F.col("entry_fill") * 1.001
    return fills.withColumns({"net_return": (F.col("exit_fill") * 0.999 - cost) / F.nullif(cost, F.lit(0.0)), "gross_return": F.col("exit_open") / F.col("entry_open") - 1})


@query("labels_cost_aware", f"{_LAB} SELECT symbol, candle_index, candle_index + 1 AS entry_index, candle_index + 4 AS exit_index, round(entry_fill, 4) AS entry_fill, round(exit_fill, 4) AS exit_fill, round(gross_return, 6) AS gross_return, round(net_return, 6) AS net_return, net_return > {HURDLE} AS positive FROM net")
def labels_cost_aware(spark, d):
    return _labels(spark, d).select("symbol", "candle_index", (F.col("candle_index") + 1).alias("entry_index"), (F.col("candle_index") + 4).alias("exit_index"), _r(F.col("entry_fill"), 4).alias("entry_fill"), _r(F.col("exit_fill"), 4).alias("exit_fill"), _r(F.col("gross_return"), 6).alias("gross_return"), _r(F.col("net_return"), 6).alias("net_return"), (F.col("net_return") > HURDLE).alias("positive"))


@query("label_balance", f"{_LAB} SELECT symbol, count(*) AS n, sum((net_return > {HURDLE})::INT)::BIGINT AS n_positive, round(count(*) / (2.0 * sum((net_return > {HURDLE})::INT)), 8) AS weight_positive FROM net GROUP BY symbol")
def label_balance(spark, d):
    hit = F.sum((F.col("net_return") > HURDLE).cast("bigint"))
    return _labels(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), hit.alias("n_positive"), _r(F.count("*") / F.nullif(2.0 * hit, F.lit(0.0))).alias("weight_positive"))


@query("legacy_regime_labels", f"{WITH} SELECT symbol, candle_index, CASE WHEN close > 0 THEN CASE WHEN lead(close, 3) OVER s / close - 1 > 0.004 THEN 'up' WHEN lead(close, 3) OVER s / close - 1 < -0.004 THEN 'down' ELSE 'flat' END END AS label FROM seg {WIN} QUALIFY lead(close, 3) OVER s IS NOT NULL")
def legacy_regime_labels(spark, d):
    x = _seg(spark, d).select("symbol", "candle_index", "close", F.lead("close", 3).over(S()).alias("later")).where("later IS NOT NULL")
    move = F.col("later") / F.col("close") - 1
    return x.select("symbol", "candle_index", F.when(F.col("close") > 0, F.when(move > 0.004, "up").when(move < -0.004, "down").otherwise("flat")).alias("label"))


@query("bollinger20", f"{WITH} SELECT symbol, candle_index, round(avg(close) OVER w, 8) AS middle, round(avg(close) OVER w + 2 * stddev_samp(close) OVER w, 8) AS upper, round(avg(close) OVER w - 2 * stddev_samp(close) OVER w, 8) AS lower FROM seg WINDOW w AS (PARTITION BY symbol ORDER BY candle_index ROWS 19 PRECEDING) QUALIFY count(*) OVER w = 20")
def bollinger20(spark, d):
    w = S().rowsBetween(-19, 0)
    x = _seg(spark, d).select("symbol", "candle_index", F.avg("close").over(w).alias("m"), F.stddev_samp("close").over(w).alias("sd"), F.count("*").over(w).alias("k")).where("k = 20")
    return x.select("symbol", "candle_index", _r(F.col("m")).alias("middle"), _r(F.col("m") + 2 * F.col("sd")).alias("upper"), _r(F.col("m") - 2 * F.col("sd")).alias("lower"))


@query("rsi14", f"{WITH}, x AS (SELECT symbol, candle_index, close - lag(close) OVER s AS c FROM seg {WIN}), y AS (SELECT symbol, candle_index, avg(greatest(c, 0)) OVER w AS up, avg(greatest(-c, 0)) OVER w AS down, count(c) OVER w AS k FROM x WINDOW w AS (PARTITION BY symbol ORDER BY candle_index ROWS 13 PRECEDING)) SELECT symbol, candle_index, round(CASE WHEN k < 14 OR down = 0 THEN 50.0 ELSE 100 - 100 / (1 + up / down) END, 8) AS rsi FROM y")
def rsi14(spark, d):
    x = _seg(spark, d).select("symbol", "candle_index", (F.col("close") - F.lag("close").over(S())).alias("c"))
    w = S().rowsBetween(-13, 0)
    up = F.when(F.col("c").isNotNull(), F.greatest("c", F.lit(0.0))).otherwise(0.0)
    down = F.when(F.col("c").isNotNull(), F.greatest(-F.col("c"), F.lit(0.0))).otherwise(0.0)
    y = x.select("symbol", "candle_index", F.avg(up).over(w).alias("up"), F.avg(down).over(w).alias("down"), F.count("c").over(w).alias("k"))
    return y.select("symbol", "candle_index", _r(F.when((F.col("k") < 14) | (F.col("down") == 0), 50.0).otherwise(100 - 100 / (1 + F.col("up") / F.nullif("down", F.lit(0.0))))).alias("rsi"))


_REG = f"""{BASE}, q AS (SELECT symbol, candle_index, (rv6) / nullif(rv42, 0) AS vol, tr / nullif(atr24, 0) AS trr, abs(ema12 - ema42) / nullif(atr24, 0) AS strength, streak FROM base),
regime AS (SELECT symbol, candle_index, CASE WHEN vol >= 1.75 OR trr >= 2.5 THEN 'UNSTABLE' WHEN strength >= 1.0 AND vol < 1.5 AND streak >= 3 THEN 'TRENDING' WHEN strength <= 0.5 AND vol <= 1.25 THEN 'RANGING' ELSE 'INDETERMINATE' END AS state FROM q WHERE vol IS NOT NULL AND trr IS NOT NULL AND strength IS NOT NULL)"""


def regime_of(vol, trr, strength, streak):
    """The state that four features (columns) say."""
    vol, trr, strength, streak = map(F.col, (vol, trr, strength, streak))
    return F.when((vol >= 1.75) | (trr >= 2.5), "UNSTABLE").when((strength >= 1) & (vol < 1.5) & (streak >= 3), "TRENDING").when((strength <= 0.5) & (vol <= 1.25), "RANGING").otherwise("INDETERMINATE")


def _regimes(spark, d):
    made = ft.registry()
    q = ft.base(_seg(spark, d)).select("symbol", "candle_index", made["volatility_ratio_6_42"].alias("vol"), made["true_range_ratio_24"].alias("trr"), made["trend_strength_12_42_atr24"].alias("strength"), "streak").dropna()
    return q.select("symbol", "candle_index", regime_of("vol", "trr", "strength", "streak").alias("state"))


query("regimes", f"{_REG} SELECT * FROM regime")(_regimes)


@query("regime_counts", f"{_REG} SELECT s.state, count(r.symbol) AS n FROM (VALUES ('TRENDING'), ('RANGING'), ('UNSTABLE'), ('INDETERMINATE')) s(state) LEFT JOIN regime r USING (state) GROUP BY s.state")
def regime_counts(spark, d):
    states = spark.createDataFrame([(x,) for x in ("TRENDING", "RANGING", "UNSTABLE", "INDETERMINATE")], "state string")
    counts = _regimes(spark, d).groupBy("state").agg(F.count("*").alias("k"))
    return states.join(counts, "state", "left").select("state", F.coalesce("k", F.lit(0)).cast("bigint").alias("n"))


# Schedules ------------------------------------------------------------------------------------------------------
_ACT = "CASE WHEN held AND NOT before THEN 'ENTER' WHEN held THEN 'HOLD' WHEN before THEN 'EXIT' ELSE 'CASH' END"
_DON = f"""{WITH}, sig AS (SELECT symbol, candle_index, close, CASE WHEN candle_index >= 20 AND close > max(high) OVER hi THEN 1 WHEN candle_index >= 20 AND close < min(low) OVER lo THEN 0 END AS sig FROM seg
 WINDOW hi AS (PARTITION BY symbol ORDER BY candle_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), lo AS (PARTITION BY symbol ORDER BY candle_index ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
latch AS (SELECT symbol, candle_index, close, coalesce(last_value(sig IGNORE NULLS) OVER s, 0) = 1 AS held FROM sig {WIN}),
sched AS (SELECT symbol, candle_index, close, held, coalesce(lag(held) OVER s, false) AS before FROM latch {WIN})"""


def _actions(latch: DataFrame) -> DataFrame:
    x = latch.withColumn("before", F.coalesce(F.lag("held").over(S()), F.lit(False)))
    return x.withColumn("action", F.when(F.col("held") & ~F.col("before"), "ENTER").when(F.col("held"), "HOLD").when(F.col("before"), "EXIT").otherwise("CASH"))


def _donchian(spark, d):
    sig = F.when((F.col("candle_index") >= 20) & (F.col("close") > F.max("high").over(S().rowsBetween(-20, -1))), 1).when((F.col("candle_index") >= 20) & (F.col("close") < F.min("low").over(S().rowsBetween(-10, -1))), 0)
    x = _seg(spark, d).withColumn("sig", sig)
    return _actions(x.withColumn("held", F.coalesce(F.last("sig", ignorenulls=True).over(S()), F.lit(0)) == 1))


@query("baseline_donchian_20_10", f"{_DON} SELECT symbol, candle_index, {_ACT} AS action FROM sched")
def baseline_donchian(spark, d):
    return _donchian(spark, d).select("symbol", "candle_index", "action")


@query("baseline_buy_hold", f"{WITH} SELECT symbol, candle_index, CASE WHEN candle_index = 0 THEN 'ENTER' ELSE 'HOLD' END AS action FROM seg")
def baseline_buy_hold(spark, d):
    return _seg(spark, d).select("symbol", "candle_index", F.when(F.col("candle_index") == 0, "ENTER").otherwise("HOLD").alias("action"))


@query("baseline_cash", f"{WITH} SELECT symbol, candle_index, 'CASH' AS action FROM seg")
def baseline_cash(spark, d):
    return _seg(spark, d).select("symbol", "candle_index", F.lit("CASH").alias("action"))


_EMA = f"""{WITH}, pre AS (SELECT symbol, candle_index, list(close) OVER s AS l FROM seg {WIN}),
latch AS (SELECT symbol, candle_index, candle_index >= 49 AND list_reduce(l, lambda e, x: e + {2 / 21!r}::DOUBLE * (x - e)) > list_reduce(l, lambda e, x: e + {2 / 51!r}::DOUBLE * (x - e)) AS held FROM pre),
sched AS (SELECT symbol, candle_index, held, coalesce(lag(held) OVER s, false) AS before FROM latch {WIN})"""


@query("baseline_ema_20_50", f"{_EMA} SELECT symbol, candle_index, {_ACT} AS action FROM sched")
def baseline_ema(spark, d):
    """Recursive from the first bar, so one pass over a symbol's closes (a price history) gives all its averages."""
    step = lambda z, x: F.struct((z["f"] + 2 / 21 * (x["c"] - z["f"])).alias("f"), (z["s"] + 2 / 51 * (x["c"] - z["s"])).alias("s"), F.concat(z["out"], F.array(F.struct(x["i"].alias("i"), (z["f"] + 2 / 21 * (x["c"] - z["f"]) > z["s"] + 2 / 51 * (x["c"] - z["s"])).alias("up")))).alias("out"))
    series = _seg(spark, d).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.col("candle_index").alias("i"), F.col("close").alias("c")))).alias("l"))
    seed = F.struct(F.col("l")[0]["c"].alias("f"), F.col("l")[0]["c"].alias("s"), F.array().cast("array<struct<i:bigint,up:boolean>>").alias("out"))
    rows = series.select("symbol", F.explode(F.aggregate("l", seed, step)["out"]).alias("o"))
    latch = rows.select("symbol", F.col("o.i").alias("candle_index"), ((F.col("o.i") >= 49) & F.col("o.up")).alias("held"))
    return _actions(latch).select("symbol", "candle_index", "action")


@query("baseline_zscore24")
def baseline_zscore(spark, d):
    return sequential.zscore_schedule(_seg(spark, d))


@query("sim_fills")
def sim_fills(spark, d):
    return sequential.simulate(_seg(spark, d), _donchian(spark, d).select("symbol", "candle_index", "action"), participation="1")


# Paths, trades and metrics --------------------------------------------------------------------------------------
# The Donchian schedule held from the next bar on; bars at a price of zero earn nothing.
_PATH = f"""{_DON}, ret AS (SELECT symbol, candle_index, close, held, before, CASE WHEN before AND lag(close) OVER s > 0 THEN close / lag(close) OVER s - 1 ELSE 0 END AS r FROM sched {WIN}),
path AS (SELECT symbol, candle_index, r, before, exp(sum(ln(greatest(1 + r, 1e-9))) OVER s) AS equity FROM ret {WIN}),
dd AS (SELECT *, greatest(1, max(equity) OVER s) AS peak FROM path {WIN})"""


def _path(spark, d):
    prev = F.lag("close").over(S())
    ret = _donchian(spark, d).withColumn("r", F.when(F.col("before") & (prev > 0), F.col("close") / F.nullif(prev, F.lit(0.0)) - 1).otherwise(0.0))
    eq = ret.withColumn("equity", F.exp(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-9)))).over(S().rowsBetween(Window.unboundedPreceding, 0))))
    return eq.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(S().rowsBetween(Window.unboundedPreceding, 0))))


@query("equity_curve_drawdown", f"{_PATH} SELECT symbol, candle_index, round(ln(equity), 6) AS log_equity, round(1 - equity / peak, 6) AS drawdown FROM dd")
def equity_curve(spark, d):
    return _path(spark, d).select("symbol", "candle_index", _r(F.ln("equity"), 6).alias("log_equity"), _r(1 - F.col("equity") / F.col("peak"), 6).alias("drawdown"))


@query(
    "path_metrics",
    f"""{_PATH} SELECT symbol, count(*) AS observed_periods, round(max(1 - equity / peak), 6) AS max_drawdown, round(avg(before::INT), 8) AS exposure,
 round(stddev_pop(r) * sqrt(2190), 6) AS annual_volatility, round(sqrt(avg(pow(least(r, 0), 2))) * sqrt(2190), 6) AS downside FROM dd GROUP BY symbol""",
)
def path_metrics(spark, d):
    r = F.col("r")
    return _path(spark, d).groupBy("symbol").agg(F.count("*").alias("observed_periods"), _r(F.max(1 - F.col("equity") / F.col("peak")), 6).alias("max_drawdown"), _r(F.avg(F.col("before").cast("int"))).alias("exposure"), _r(F.stddev_pop(r) * F.sqrt(F.lit(2190.0)), 6).alias("annual_volatility"), _r(F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2)))) * F.sqrt(F.lit(2190.0)), 6).alias("downside"))


_TRD = f"""{_DON}, num AS (SELECT *, sum((held AND NOT before)::INT) OVER s AS trade FROM sched {WIN}),
trades AS (SELECT symbol, trade::BIGINT AS trade, min(candle_index) AS entry_index, max(candle_index) AS exit_index, arg_min(close, candle_index) AS entry_close, arg_max(close, candle_index) AS exit_close
 FROM num WHERE trade > 0 AND (held OR before) GROUP BY ALL HAVING NOT bool_and(held))"""


def _trades(spark, d):
    x = _donchian(spark, d).withColumn("trade", F.sum((F.col("held") & ~F.col("before")).cast("bigint")).over(S().rowsBetween(Window.unboundedPreceding, 0))).where("trade > 0 AND (held OR before)")
    return x.groupBy("symbol", "trade").agg(F.min("candle_index").alias("entry_index"), F.max("candle_index").alias("exit_index"), F.min_by("close", "candle_index").alias("entry_close"), F.max_by("close", "candle_index").alias("exit_close"), F.bool_and("held").alias("open")).where("NOT open").drop("open")


@query("trades_flat_to_flat", f"{_TRD} SELECT symbol, trade, entry_index, exit_index, exit_index - entry_index AS hold, round(exit_close - entry_close, 8) AS pnl, exit_close > entry_close AS winning FROM trades")
def trades(spark, d):
    return _trades(spark, d).select("symbol", "trade", "entry_index", "exit_index", (F.col("exit_index") - F.col("entry_index")).alias("hold"), _r(F.col("exit_close") - F.col("entry_close")).alias("pnl"), (F.col("exit_close") > F.col("entry_close")).alias("winning"))


@query("trade_stats", f"{_TRD} SELECT symbol, count(*) AS n, round(avg((exit_close > entry_close)::INT), 8) AS win_rate, round(sum(greatest(exit_close - entry_close, 0)) / nullif(sum(greatest(entry_close - exit_close, 0)), 0), 6) AS profit_factor, round(max(greatest(exit_close - entry_close, 0)) / nullif(sum(greatest(exit_close - entry_close, 0)), 0), 6) AS concentration FROM trades GROUP BY symbol")
def trade_stats(spark, d):
    gain, loss = F.greatest(F.col("exit_close") - F.col("entry_close"), F.lit(0.0)), F.greatest(F.col("entry_close") - F.col("exit_close"), F.lit(0.0))
    return _trades(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), _r(F.avg((F.col("exit_close") > F.col("entry_close")).cast("int"))).alias("win_rate"), _r(F.sum(gain) / F.nullif(F.sum(loss), F.lit(0.0)), 6).alias("profit_factor"), _r(F.max(gain) / F.nullif(F.sum(gain), F.lit(0.0)), 6).alias("concentration"))


@query("regime_attribution", f"{_TRD}, {_REG.split(WITH + ', ')[1]} SELECT coalesce(r.state, 'INDETERMINATE') AS state, count(*) AS n, round(sum(exit_close - entry_close), 6) AS pnl FROM trades t LEFT JOIN regime r ON r.symbol = t.symbol AND r.candle_index = t.exit_index GROUP BY ALL")
def regime_attribution(spark, d):
    r = _regimes(spark, d).withColumnRenamed("candle_index", "exit_index")
    return _trades(spark, d).join(r, ["symbol", "exit_index"], "left").groupBy(F.coalesce("state", F.lit("INDETERMINATE")).alias("state")).agg(F.count("*").alias("n"), _r(F.sum(F.col("exit_close") - F.col("entry_close")), 6).alias("pnl"))


@query("cost_stress", f"{_TRD} SELECT symbol, multiple, round(sum((exit_close * (1 - 0.0025 * multiple) - entry_close * (1 + 0.0025 * multiple))), 8) AS pnl FROM trades, (VALUES (1.0::DOUBLE), (1.5), (2.0)) m(multiple) GROUP BY ALL")
def cost_stress(spark, d):
    x = _trades(spark, d).withColumn("multiple", F.explode(F.array(*map(F.lit, (1.0, 1.5, 2.0)))))
    m = 0.0025 * F.col("multiple")
    return x.groupBy("symbol", "multiple").agg(_r(F.sum(F.col("exit_close") * (1 - m) - F.col("entry_close") * (1 + m)), 8).alias("pnl"))


# Folds ----------------------------------------------------------------------------------------------------------
_FOLD = f"""WITH d AS (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS i FROM ({b.ITEM_BARS_SQL})),
lim AS (SELECT symbol, min(open_time) AS t0, max(open_time) AS t1 FROM d GROUP BY symbol),
f AS (SELECT symbol, k AS fold, t0 + to_months((24 + 6 * k)::INT) AS cs, t0 + to_months((30 + 6 * k)::INT) AS ce, t0 + to_months((36 + 6 * k)::INT) AS te, t1 FROM (SELECT *, unnest(range(0, 2 + date_diff('month', t0, t1) // 6)) AS k FROM lim) WHERE te <= t1),
folds AS (SELECT f.symbol, fold, count(*) FILTER (open_time < cs) AS c0, count(*) FILTER (open_time < ce) AS c1, count(*) FILTER (open_time < te) AS c2 FROM f JOIN d USING (symbol) GROUP BY ALL)"""


def _folds(spark, d, bars=None):
    x = (b.item_bars(spark, d) if bars is None else bars).select("symbol", "open_time")
    lim = x.groupBy("symbol").agg(F.min("open_time").alias("t0"), F.max("open_time").alias("t1"))
    months = lambda n: F.expr(f"t0 + make_ym_interval(0, cast({n} + 6 * fold as int))")
    f = lim.withColumn("fold", F.explode(F.sequence(F.lit(0), (F.months_between("t1", "t0") / 6 + 1).cast("int")))).withColumns({"cs": months(24), "ce": months(30), "te": months(36)}).where("te <= t1")
    before = lambda c: F.count_if(F.col("open_time") < F.col(c))
    return f.join(x, "symbol").groupBy("symbol", F.col("fold").cast("bigint").alias("fold")).agg(before("cs").alias("c0"), before("ce").alias("c1"), before("te").alias("c2"))


@query("wf_folds", f"{_FOLD} SELECT symbol, fold, 42 AS train_start, c0 - 3 AS train_end, c0 + 3 AS cal_start, c1 - 3 AS cal_end, c1 + 3 AS test_start, c2 - 3 AS test_end FROM folds")
def wf_folds(spark, d):
    c = F.col
    return _folds(spark, d).select("symbol", "fold", F.lit(42).alias("train_start"), (c("c0") - 3).alias("train_end"), (c("c0") + 3).alias("cal_start"), (c("c1") - 3).alias("cal_end"), (c("c1") + 3).alias("test_start"), (c("c2") - 3).alias("test_end"))


@query("wf_safe_indices", f"{_FOLD}, e AS (SELECT DISTINCT symbol, unnest([c0, c1, c2]) AS b FROM folds) SELECT f.symbol, f.fold, count(*) AS n, min(d.i) AS first_index, max(d.i) AS last_index FROM folds f JOIN d ON d.symbol = f.symbol AND d.i >= f.c1 + 3 AND d.i + 4 < f.c2 - 3 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.symbol = d.symbol AND e.b > d.i - 3 AND e.b <= d.i + 4) GROUP BY ALL")
def wf_safe_indices(spark, d):
    """The forbidden indices around each boundary are listed (seven a boundary), so the anti-join is an equi-join."""
    folds = _folds(spark, d)
    x = b.item_bars(spark, d).select("symbol", "open_time")
    idx = x.select("symbol", (F.row_number().over(Window.partitionBy("symbol").orderBy("open_time")) - 1).cast("bigint").alias("i"))
    near = folds.select("symbol", F.explode(F.array("c0", "c1", "c2")).alias("b")).select("symbol", F.explode(F.sequence(F.col("b") - 4, F.col("b") + 2)).alias("i")).distinct()
    inside = idx.join(near, ["symbol", "i"], "left_anti").join(folds, "symbol").where("i >= c1 + 3 AND i + 4 < c2 - 3")
    return inside.groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.min("i").alias("first_index"), F.max("i").alias("last_index"))


# Calibration ----------------------------------------------------------------------------------------------------
_SC = f"{_LAB}, sc AS (SELECT symbol AS fold, candle_index, ((candle_index * 37) % 101) / 101.0 - 0.5 AS score, net_return > {HURDLE} AS positive, gross_return FROM net), p AS (SELECT *, 1 / (1 + exp(-(1.5 * score - 0.2))) AS p FROM sc)"


def _scores(spark, d):
    x = _labels(spark, d).select(F.col("symbol").alias("fold"), "candle_index", ((F.col("candle_index") * 37) % 101 / 101.0 - 0.5).alias("score"), (F.col("net_return") > HURDLE).alias("positive"), "gross_return")
    return x.withColumn("p", 1 / (1 + F.exp(-(1.5 * F.col("score") - 0.2))))


@query("platt_apply", f"{_SC} SELECT fold, candle_index, round(p, 8) AS p FROM p")
def platt_apply(spark, d):
    return _scores(spark, d).select("fold", "candle_index", _r(F.col("p")).alias("p"))


@query("platt_fit", f"""{_SC.replace("WITH ", "WITH RECURSIVE ", 1)}, fit AS (SELECT fold, score, positive::INT AS y FROM sc WHERE fold IN (SELECT fold FROM sc GROUP BY fold HAVING count(*) >= 200 AND sum(positive::INT) >= 40 AND sum((NOT positive)::INT) >= 40)),
newton AS (
 SELECT fold, 0 AS k, 0.0::DOUBLE AS a, ln(sum(y) / sum(1 - y))::DOUBLE AS b FROM fit GROUP BY fold
 UNION ALL
 SELECT fold, k + 1, a - (gs * ii - gi * si) / (ss * ii - si * si), b - (gi * ss - gs * si) / (ss * ii - si * si) FROM (
  SELECT fold, k, a, b, sum((p - y) * score) AS gs, sum(p - y) AS gi, sum(p * (1 - p) * score * score) + 1e-12 AS ss, sum(p * (1 - p) * score) AS si, sum(p * (1 - p)) + 1e-12 AS ii
  FROM (SELECT n.fold, n.k, n.a, n.b, f.score, f.y, 1 / (1 + exp(-(n.a * f.score + n.b))) AS p FROM newton n JOIN fit f ON n.fold = f.fold WHERE n.k < 12) GROUP BY fold, k, a, b))
SELECT c.fold, c.n, c.n_positive, round(a, 6) AS slope, round(b, 6) AS intercept FROM (SELECT fold, count(*) AS n, sum(positive::INT)::BIGINT AS n_positive FROM sc GROUP BY fold) c LEFT JOIN (SELECT * FROM newton WHERE k = 12) USING (fold)""")
def platt_fit(spark, d):
    """Folds of 200 rows with 40 of either class are calibrated; the others have no fit."""
    x = _scores(spark, d).select("fold", "score", "positive")
    hits = F.sum(F.col("positive").cast("bigint"))
    counts = x.groupBy("fold").agg(F.count("*").alias("n"), hits.alias("n_positive"))
    enough = counts.where("n >= 200 AND n_positive >= 40 AND n - n_positive >= 40").select("fold")
    fits = specialists.platt(x.join(enough, "fold", "left_semi")).select("fold", _r(F.col("slope"), 6).alias("slope"), _r(F.col("intercept"), 6).alias("intercept"))
    return counts.join(fits, "fold", "left")


@query("brier_logloss_ece", f"""{_SC}, bin AS (SELECT fold, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(positive::INT) AS my FROM p GROUP BY ALL),
ece AS (SELECT fold, sum(n * abs(mp - my)) / sum(n) AS ece FROM bin GROUP BY fold), s AS (SELECT fold, avg(pow(p - positive::INT, 2)) AS brier, avg(CASE WHEN positive THEN -ln(p) ELSE -ln(1 - p) END) AS ll FROM p GROUP BY fold)
SELECT fold, round(brier, 8) AS brier, round(ll, 8) AS log_loss, round(ece, 8) AS ece FROM s JOIN ece USING (fold)""")
def brier_logloss_ece(spark, d):
    x = _scores(spark, d)
    y = F.col("positive").cast("int")
    bins = x.groupBy("fold", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("b")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg(y).alias("my"), F.sum(F.pow(F.col("p") - y, F.lit(2))).alias("sq"), F.sum(F.when(F.col("positive"), -F.ln("p")).otherwise(-F.ln(1 - F.col("p")))).alias("ll"))
    return bins.groupBy("fold").agg(_r(F.sum("sq") / F.sum("n")).alias("brier"), _r(F.sum("ll") / F.sum("n")).alias("log_loss"), _r(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


@query("expected_return_ols", f"{_SC} SELECT fold, round(regr_slope(gross_return, p), 6) AS slope, round(regr_intercept(gross_return, p), 6) AS intercept FROM p GROUP BY fold")
def expected_return_ols(spark, d):
    return _scores(spark, d).groupBy("fold").agg(_r(F.regr_slope("gross_return", "p"), 6).alias("slope"), _r(F.regr_intercept("gross_return", "p"), 6).alias("intercept"))


@query("entry_threshold_q75", f"{_SC} SELECT fold, round(greatest(quantile_cont(p, 0.75), 0.5), 8) AS threshold, count(*) AS n FROM p GROUP BY fold HAVING count(*) >= 40")
def entry_threshold(spark, d):
    return _scores(spark, d).groupBy("fold").agg(_r(F.greatest(F.percentile("p", 0.75), F.lit(0.5))).alias("threshold"), F.count("*").alias("n")).where("n >= 40")


# Identity -------------------------------------------------------------------------------------------------------
@query("row_hash_identity", f"{WITH} SELECT symbol, candle_index, sha256(concat_ws('|', symbol, strftime(open_time, '%Y-%m-%dT%H:%M:%S.%gZ'), volume::VARCHAR)) AS row_sha256 FROM seg")
def row_hash_identity(spark, d):
    stamp = F.date_format("open_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return _seg(spark, d).select("symbol", "candle_index", F.sha2(F.concat_ws("|", "symbol", stamp, F.col("volume").cast("string")), 256).alias("row_sha256"))


@query("kline_parse", "SELECT 'ABUSD' AS symbol, make_timestamp(1704067200000000 + (event_id * 3600000000)::BIGINT) AS open_time, round(value, 4)::DOUBLE AS close FROM events")
def kline_parse(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round("value", 4).cast("decimal(12,4)").cast("string").alias("x"))
    ms = (F.lit(1704067200000) + F.col("event_id") * 3600000).cast("bigint")
    row = F.array(ms.cast("string"), "x", "x", "x", "x", F.lit("1"), (ms + 3599999).cast("string"))
    pages = e.select(F.to_json(F.array(row)).alias("body"))
    return b.klines(pages, "ABUSD").select("symbol", F.col("open_time").cast("timestamp_ntz").alias("open_time"), F.col("close").cast("double").alias("close"))
