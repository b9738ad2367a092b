"""Queries that check inputs, compare declared with found, measure returns and apply exported models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.functions.rounding import rounded
from barweave.plans import queries as q

c, r8 = F.col, rounded
END = "open_time + INTERVAL '1' HOUR - INTERVAL '0.001' SECOND"


# Inputs ---------------------------------------------------------------------------------------------------------
@q.query("request_window", f"{q.WITH} SELECT symbol, count(*) FILTER (open_time >= TIMESTAMP '2024-01-05' AND open_time < TIMESTAMP '2024-01-20') AS inside, count(*) FILTER (open_time < TIMESTAMP '2024-01-05') AS early, count(*) FILTER (open_time >= TIMESTAMP '2024-01-20') AS late FROM seg GROUP BY symbol")
def request_window(spark, d):
    """A half-open window: its end is outside."""
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-20"))
    t = c("open_time")
    return q._seg(spark, d).groupBy("symbol").agg(F.count_if((t >= low) & (t < high)).alias("inside"), F.count_if(t < low).alias("early"), F.count_if(t >= high).alias("late"))


@q.query("identifiers", "SELECT event_type AS raw, upper(trim(event_type)) AS identifier, regexp_full_match(upper(trim(event_type)), '[A-Z0-9]{2,30}') AS valid, count(*) AS n FROM events GROUP BY ALL")
def identifiers(spark, d):
    name = F.upper(F.trim("event_type"))
    return spark.read.parquet(f"{d}/events.parquet").groupBy(c("event_type").alias("raw"), name.alias("identifier"), F.regexp_like(name, F.lit("^[A-Z0-9]{2,30}$")).alias("valid")).agg(F.count("*").alias("n"))


@q.query("decimal_text", "SELECT event_id, regexp_replace(round(value::DECIMAL(18,6), 4)::DECIMAL(18,4)::VARCHAR, '[.]?0+$', '') AS text FROM events")
def decimal_text(spark, d):
    """Decimals without exponent or trailing zeros; all have a point, so whole tens keep theirs."""
    exact = F.expr("cast(round(cast(value as decimal(18,6)), 4) as decimal(18,4))").cast("string")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.regexp_replace(exact, "[.]?0+$", "").alias("text"))


_ARRIVED = f"""{q.WITH}, a AS (SELECT symbol, open_time, CASE candle_index % 50 WHEN 0 THEN candle_index + 1 WHEN 1 THEN candle_index - 1 ELSE candle_index END AS place, 0 AS copy FROM seg
 UNION ALL SELECT symbol, open_time, candle_index, 1 FROM seg WHERE candle_index % 40 = 7)"""


@q.query("bar_arrival_faults", f"{_ARRIVED}, b AS (SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY place, copy) AS before, count(*) OVER (PARTITION BY symbol, open_time) AS k FROM a) SELECT symbol, count(*) FILTER (k > 1) AS duplicated, count(*) FILTER (open_time < before) AS out_of_order, count(*) AS arrived FROM b GROUP BY symbol")
def bar_arrival_faults(spark, d):
    """Bars as they arrive, some twice and some swapped: what is repeated, and what is not later than its forerunner."""
    seg, i = q._seg(spark, d), c("candle_index")
    first = seg.select("symbol", "open_time", F.when(i % 50 == 0, i + 1).when(i % 50 == 1, i - 1).otherwise(i).alias("place"), F.lit(0).alias("copy"))
    both = first.unionByName(seg.where(i % 40 == 7).select("symbol", "open_time", i.alias("place"), F.lit(1).alias("copy")))
    told = both.withColumns({"before": F.lag("open_time").over(Window.partitionBy("symbol").orderBy("place", "copy")), "k": F.count("*").over(Window.partitionBy("symbol", "open_time"))})
    return told.groupBy("symbol").agg(F.count_if(c("k") > 1).alias("duplicated"), F.count_if(c("open_time") < c("before")).alias("out_of_order"), F.count("*").alias("arrived"))


@q.query("close_time_check", f"{q.WITH}, x AS (SELECT symbol, open_time, open_time + INTERVAL '1 hour' - CASE WHEN candle_index % 60 = 0 THEN INTERVAL '2 milliseconds' ELSE INTERVAL '1 millisecond' END AS close_time FROM seg) SELECT symbol, count(*) FILTER (close_time = open_time + INTERVAL '1 hour' - INTERVAL '1 millisecond') AS whole, count(*) FILTER (close_time <> open_time + INTERVAL '1 hour' - INTERVAL '1 millisecond') AS partial_bars FROM x GROUP BY symbol")
def close_time_check(spark, d):
    """A bar ends one millisecond before the next slot; others are partial."""
    x = q._seg(spark, d).select("symbol", "open_time", F.when(c("candle_index") % 60 == 0, F.expr(f"{END} - INTERVAL '0.001' SECOND")).otherwise(F.expr(END)).alias("close_time"))
    whole = c("close_time") == F.expr(END)
    return x.groupBy("symbol").agg(F.count_if(whole).alias("whole"), F.count_if(~whole).alias("partial_bars"))


@q.query(
    "declared_closures",
    f"""{q._GAPS}, days AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL '1 day')) AS day),
dec AS (SELECT symbol, day + INTERVAL '3 hours' AS expected_open, day + to_hours(hours) AS resumed_open FROM days, (VALUES (4), (5)) h(hours), (SELECT DISTINCT symbol FROM seg))
SELECT symbol, expected_open, resumed_open, CASE WHEN d.symbol IS NULL THEN 'illegal_jump' WHEN g.symbol IS NULL THEN 'unused_declaration' ELSE 'declared' END AS status
FROM gaps g FULL OUTER JOIN dec d USING (symbol, expected_open, resumed_open)""",
)
def declared_closures(spark, d):
    """Closures are declared for themselves (nightly maintenance of one or two hours) and held against the gaps found:
    jumps without a declaration, and declarations that nothing uses."""
    days = F.explode(F.expr("sequence(TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-01-30', INTERVAL 1 DAY)")).alias("day")
    nights = q._seg(spark, d).select("symbol").distinct().select("symbol", days)
    ends = F.explode(F.expr("array(day + INTERVAL '4' HOUR, day + INTERVAL '5' HOUR)")).alias("resumed_open")
    declared = nights.select("symbol", F.expr("day + INTERVAL '3' HOUR").alias("expected_open"), ends).withColumn("declared", F.lit(True))
    joined = q._gaps(spark, d).withColumn("found", F.lit(True)).join(declared, ["symbol", "expected_open", "resumed_open"], "full_outer")
    status = F.when(c("declared").isNull(), "illegal_jump").when(c("found").isNull(), "unused_declaration").otherwise("declared")
    return joined.select("symbol", "expected_open", "resumed_open", status.alias("status"))


@q.query("decision_keys", f"{q._DON} SELECT symbol, count(*) AS decisions, count(DISTINCT candle_index) AS distinct_keys, count(*) = count(DISTINCT candle_index) AS are_unique FROM sched GROUP BY symbol")
def decision_keys(spark, d):
    """One decision a bar: decisions counted by key first, so no distinct set is held."""
    keys = q._donchian(spark, d).groupBy("symbol", "candle_index").agg(F.count("*").alias("k"))
    return keys.groupBy("symbol").agg(F.sum("k").alias("decisions"), F.count("*").alias("distinct_keys"), (F.sum("k") == F.count("*")).alias("are_unique"))


_GUARD = "CASE WHEN quantity <= 0 THEN 'quantity' WHEN position <= 0 THEN 'flat' WHEN quantity > position THEN 'oversell' WHEN NOT (low < close AND close < high) THEN 'geometry' ELSE 'ok' END"


@q.query("order_guards", f"{q.WITH} SELECT symbol, {_GUARD} AS reason, count(*) AS n FROM (SELECT symbol, low, close, high, volume % 4 - 1 AS quantity, candle_index % 5 AS position FROM seg) GROUP BY ALL")
def order_guards(spark, d):
    """Sell-to-close and the order of stop, entry and target; the first rule that is broken."""
    x = q._seg(spark, d).select("symbol", "low", "close", "high", (c("volume") % 4 - 1).alias("quantity"), (c("candle_index") % 5).alias("position"))
    return x.groupBy("symbol", F.expr(_GUARD).alias("reason")).agg(F.count("*").alias("n"))


# Windows of events ----------------------------------------------------------------------------------------------
@q.query("event_sessions", "WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '6 hours')::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("w")


@q.query("event_sliding", "SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start FROM events) GROUP BY ALL")
def event_sliding(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", c("w.start").alias("start"), "n")


# Returns --------------------------------------------------------------------------------------------------------
_BOTH = f"{q._PATH}{q._TRD[len(q._DON) :]}"


@q.query(
    "return_metrics",
    f"""{_BOTH}, t AS (SELECT symbol, sum(exit_close - entry_close) AS gross, sum(exit_close * 0.9975 - entry_close * 1.0025) AS net, sum(exit_close + entry_close) AS notional FROM trades GROUP BY symbol),
m AS (SELECT symbol, count(*) AS n, max(1 - equity / peak) AS dd, sqrt(avg(pow(least(r, 0), 2))) * sqrt(2190) AS downside, avg(equity) AS mean_equity, avg(before::INT) AS exposure FROM dd GROUP BY symbol)
SELECT symbol, round(gross / 10000, 6) AS gross_return, round(net / 10000, 6) AS net_return, round(pow(1 + net / 10000, 2190 // n) - 1, 6) AS annual_floor, round(pow(1 + net / 10000, 2190 / n) - 1, 6) AS annual_exact,
 round((pow(1 + net / 10000, 2190 // n) - 1) / nullif(downside, 0), 5) AS sortino, round((pow(1 + net / 10000, 2190 // n) - 1) / nullif(dd, 0), 5) AS return_to_drawdown,
 round(notional / 10000 / mean_equity, 5) AS turnover, round(net / 10000 / nullif(exposure, 0), 6) AS exposure_adjusted FROM t JOIN m USING (symbol)""",
)
def return_metrics(spark, d):
    """Of a book of 10000: returns before and after costs, annualised with the exponent floored and exact, ratios of
    the floored one (null where nothing divides), notional turned over a unit of mean equity."""
    x, e = c("exit_close"), c("entry_close")
    t = q._trades(spark, d).groupBy("symbol").agg(F.sum(x - e).alias("gross"), F.sum(x * 0.9975 - e * 1.0025).alias("net"), F.sum(x + e).alias("notional"))
    m = q._path(spark, d).groupBy("symbol").agg(
        F.count("*").alias("n"), F.max(1 - c("equity") / c("peak")).alias("dd"), (F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), F.lit(2)))) * F.sqrt(F.lit(2190.0))).alias("downside"), F.avg("equity").alias("mean_equity"), F.avg(c("before").cast("int")).alias("exposure")
    )
    zero, net = F.lit(0.0), c("net") / 10000
    exact, floored = (F.pow(1 + net, years) - 1 for years in (2190 / c("n"), F.floor(2190 / c("n"))))
    return t.join(m, "symbol").select(
        "symbol", r8(c("gross") / 10000, 6).alias("gross_return"), r8(net, 6).alias("net_return"), r8(floored, 6).alias("annual_floor"), r8(exact, 6).alias("annual_exact"),
        r8(floored / F.nullif("downside", zero), 5).alias("sortino"), r8(floored / F.nullif("dd", zero), 5).alias("return_to_drawdown"), r8(c("notional") / 10000 / c("mean_equity"), 5).alias("turnover"), r8(net / F.nullif("exposure", zero), 6).alias("exposure_adjusted"),
    )


@q.query("fold_path", f"{q._PATH}, f AS (SELECT symbol, candle_index // 100 AS fold, sum(ln(greatest(1 + r, 1e-9))) AS g FROM path GROUP BY ALL), cum AS (SELECT symbol, fold, g, sum(g) OVER s AS total FROM f WINDOW s AS (PARTITION BY symbol ORDER BY fold)) SELECT symbol, fold, round(exp(g) - 1, 6) AS fold_return, round(total, 6) AS log_equity, round(1 - exp(total - greatest(0, max(total) OVER s)), 6) AS drawdown FROM cum WINDOW s AS (PARTITION BY symbol ORDER BY fold)")
def fold_path(spark, d):
    """Returns compounded by fold, then over the folds in their order."""
    f = q._path(spark, d).groupBy("symbol", F.floor(c("candle_index") / 100).alias("fold")).agg(F.sum(F.ln(F.greatest(1 + c("r"), F.lit(1e-9)))).alias("g"))
    w = Window.partitionBy("symbol").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    x = f.withColumn("total", F.sum("g").over(w)).withColumn("peak", F.greatest(F.lit(0.0), F.max("total").over(w)))
    return x.select("symbol", "fold", r8(F.exp("g") - 1, 6).alias("fold_return"), r8(c("total"), 6).alias("log_equity"), r8(1 - F.exp(c("total") - c("peak")), 6).alias("drawdown"))


@q.query("best_comparator", f"SELECT symbol, arg_max(multiple, (coalesce(pnl, -999999), -multiple)) AS best, max(pnl) AS pnl FROM ({q.SQL['cost_stress']}) GROUP BY symbol")
def best_comparator(spark, d):
    """The case with the largest measure, missing ones last; the first of equal ones."""
    x = q.QUERIES["cost_stress"](spark, d)
    return x.groupBy("symbol").agg(F.max_by("multiple", F.struct(F.coalesce("pnl", F.lit(-999999.0)), -c("multiple"))).alias("best"), F.max("pnl").alias("pnl"))


@q.query("fold_history", f"{q._FOLD} SELECT l.symbol, date_diff('month', t0, t1) >= 84 AS enough_history, count(fold) AS folds, count(fold) >= 5 AS enough_folds FROM lim l LEFT JOIN folds f ON f.symbol = l.symbol GROUP BY ALL")
def fold_history(spark, d):
    from barweave.sources import bars as b

    lim = b.item_bars(spark, d).groupBy("symbol").agg(F.min("open_time").alias("t0"), F.max("open_time").alias("t1"))
    months = (F.year("t1") - F.year("t0")) * 12 + F.month("t1") - F.month("t0")
    folds = q._folds(spark, d).groupBy("symbol").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return lim.join(folds, "symbol", "left").select("symbol", (months >= 84).alias("enough_history"), k.alias("folds"), (k >= 5).alias("enough_folds"))


# Models ---------------------------------------------------------------------------------------------------------
# Exported: coefficients of a linear model and two trees; values at or below a cut go left.
_COEF = (0.4, -0.3, 0.1)
_RAW = f"""{q.WITH}, x AS (SELECT symbol, candle_index, close / nullif(open, 0) - 1 AS a, (high - low) / nullif(open, 0) AS b FROM seg),
m AS (SELECT symbol, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM x WHERE candle_index < 300 GROUP BY symbol),
z AS (SELECT symbol, candle_index, (a - ma) / nullif(sa, 0) AS za, (b - mb) / nullif(sb, 0) AS zb FROM x JOIN m USING (symbol))"""
_TREES = "-0.2 + 0.1 * (CASE WHEN za <= 0.0 THEN -1.0 WHEN zb <= 0.5 THEN 0.25 ELSE 0.75 END) + 0.1 * (CASE WHEN zb <= -0.25 THEN 0.5 ELSE -0.5 END)"


def _standard(spark, d):
    """Standardised by mean and population scale of each symbol's training bars; a constant feature gives null."""
    x = q._seg(spark, d).select("symbol", "candle_index", (c("close") / F.nullif("open", F.lit(0.0)) - 1).alias("a"), ((c("high") - c("low")) / F.nullif("open", F.lit(0.0))).alias("b"))
    m = x.where("candle_index < 300").groupBy("symbol").agg(*[f(k).alias(f"{n}{k}") for k in "ab" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda k: ((c(k) - c(f"m{k}")) / F.nullif(f"s{k}", F.lit(0.0))).alias(f"z{k}")
    return x.join(m, "symbol").select("symbol", "candle_index", z("a"), z("b"))


@q.query("standardised_features", f"{_RAW} SELECT symbol, candle_index, round(za, 6) AS za, round(zb, 6) AS zb FROM z")
def standardised_features(spark, d):
    return _standard(spark, d).select("symbol", "candle_index", r8(c("za"), 6).alias("za"), r8(c("zb"), 6).alias("zb"))


@q.query("portable_inference", f"{_RAW} SELECT symbol, candle_index, round({_COEF[0]} * za + {_COEF[1]} * zb + {_COEF[2]}, 6) AS linear, round({_TREES}, 6) AS trees FROM z")
def portable_inference(spark, d):
    """Exported models as columns: the sum of coefficients and features, and trees as nested cases."""
    vector, weights = F.array("za", "zb"), F.array(*map(F.lit, _COEF[:2]))
    linear = F.aggregate(F.zip_with(vector, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) + _COEF[2]
    return _standard(spark, d).select("symbol", "candle_index", r8(linear, 6).alias("linear"), r8(F.expr(_TREES).cast("double"), 6).alias("trees"))


@q.query("log_loss_clipped", f"{q._SC} SELECT fold, round(avg(CASE WHEN positive THEN -ln(k) ELSE -ln(1 - k) END), 8) AS log_loss FROM (SELECT fold, positive, least(greatest(CASE WHEN candle_index % 9 = 0 THEN 0.0 WHEN candle_index % 11 = 0 THEN 1.0 ELSE p END, 1e-15), 1 - 1e-15) AS k FROM p) GROUP BY fold")
def log_loss_clipped(spark, d):
    i = c("candle_index")
    k = F.least(F.greatest(F.when(i % 9 == 0, 0.0).when(i % 11 == 0, 1.0).otherwise(c("p")), F.lit(1e-15)), F.lit(1 - 1e-15))
    return q._scores(spark, d).withColumn("k", k).groupBy("fold").agg(r8(F.avg(F.when(c("positive"), -F.ln("k")).otherwise(-F.ln(1 - c("k"))))).alias("log_loss"))


@q.query("expected_return_apply", f"{q._SC}, fit AS (SELECT fold, regr_slope(gross_return, p) AS a, regr_intercept(gross_return, p) AS b, min(p) AS low, max(p) AS high FROM p WHERE candle_index % 2 = 0 AND candle_index % 101 > 20 GROUP BY fold) SELECT fold, candle_index, round(a * least(greatest(p, low), high) + b, 6) AS expected FROM p JOIN fit USING (fold) WHERE candle_index % 2 = 1")
def expected_return_apply(spark, d):
    """A line fitted on calibration bars, applied to others with p clamped to the range that it was fitted on."""
    x = q._scores(spark, d)
    fit = x.where("candle_index % 2 = 0 AND candle_index % 101 > 20").groupBy("fold").agg(F.regr_slope("gross_return", "p").alias("a"), F.regr_intercept("gross_return", "p").alias("b"), F.min("p").alias("low"), F.max("p").alias("high"))
    return x.where("candle_index % 2 = 1").join(fit, "fold").select("fold", "candle_index", r8(c("a") * F.least(F.greatest("p", "low"), c("high")) + c("b"), 6).alias("expected"))
