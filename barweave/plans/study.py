"""Study queries: arbitration over variants, bootstrap, gates, limit crossing and the streamed bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators.arbitration import arbitrate, verdicts, with_variants
from barweave.operators.bootstrap import block_bootstrap
from barweave.plans import queries as q
from barweave.plans.specialist import bundle
from barweave.sources import bars as b
from barweave.streaming import live_bars


def _candidates(spark, d):
    """The fold bundle's rows that test: regime, features and scores of the trained specialists."""
    rows = bundle(spark, d)["rows"].where("role = 'test'")
    return rows.select("symbol", "segment", "candle_index", "close", "low", "atr", "state", "stretch", "p_trend", "p_mean", "e_trend", "e_mean")


@q.query("arbitration_schedule")
def arbitration_schedule(spark, d):
    return arbitrate(verdicts(with_variants(_candidates(spark, d))))


@q.query("arbitration_case_summary")
def arbitration_case_summary(spark, d):
    x = arbitration_schedule(spark, d)
    return x.groupBy("symbol", "variant").agg(F.count_if(F.col("action") == "ENTER").alias("entries"), F.count_if(F.col("action") == "EXIT").alias("exits"), F.count_if(F.col("action").isin("ENTER", "HOLD")).alias("bars_long"), F.count("*").alias("bars"))


@q.query("bootstrap_blocks")
def bootstrap_blocks(spark, d):
    """Donchian against buy and hold, by symbol."""
    prev = F.lag("close").over(q.S())
    hold = F.when(prev > 0, F.col("close") / F.nullif(prev, F.lit(0.0)) - 1).otherwise(0.0)
    paths = q._donchian(spark, d).select("symbol", "candle_index", F.when(F.col("before"), hold).otherwise(0.0).alias("candidate"), hold.alias("baseline"))
    return block_bootstrap(paths)


# Gates: what is measured, the bound and its direction; one explicit failure outweighs what is missing.
_GATES = (("drawdown", "<=", 0.25), ("trades", ">=", 60.0), ("concentration", "<=", 0.25), ("log_equity", ">", 0.0))
_BOTH = f"{q._PATH}{q._TRD[len(q._DON) :]}"
_MEASURED = f"""{_BOTH}, m AS (SELECT symbol, max(1 - equity / peak) AS drawdown, arg_max(ln(equity), candle_index) AS log_equity FROM dd GROUP BY symbol),
t AS (SELECT symbol, count(*)::DOUBLE AS trades, max(greatest(exit_close - entry_close, 0)) / nullif(sum(greatest(exit_close - entry_close, 0)), 0) AS concentration FROM trades GROUP BY symbol),
g AS ({" UNION ALL ".join(f"SELECT symbol, '{n}' AS gate, {n} AS observed, {v}::DOUBLE AS required, {n} {o} {v} AS passed FROM m LEFT JOIN t USING (symbol)" for n, o, v in _GATES)})"""


def _gates(spark, d):
    gain = F.greatest(F.col("exit_close") - F.col("entry_close"), F.lit(0.0))
    t = q._trades(spark, d).groupBy("symbol").agg(F.count("*").cast("double").alias("trades"), (F.max(gain) / F.nullif(F.sum(gain), F.lit(0.0))).alias("concentration"))
    m = q._path(spark, d).groupBy("symbol").agg(F.max(1 - F.col("equity") / F.col("peak")).alias("drawdown"), F.max_by(F.ln("equity"), "candle_index").alias("log_equity"))
    rows = [F.struct(F.lit(n).alias("gate"), F.col(n).alias("observed"), F.lit(v).alias("required"), F.expr(f"{n} {o} {v}D").alias("passed")) for n, o, v in _GATES]
    return m.join(t, "symbol", "left").select("symbol", F.explode(F.array(*rows)).alias("g")).select("symbol", "g.*")


@q.query("promotion_gates", f"{_MEASURED} SELECT symbol, gate, round(observed, 6) AS observed, required, passed FROM g")
def promotion_gates(spark, d):
    return _gates(spark, d).withColumn("observed", q._r(F.col("observed"), 6))


@q.query("promotion_class", f"{_MEASURED} SELECT symbol, CASE WHEN count(*) FILTER (NOT passed) > 0 THEN 'REJECTED' WHEN count(*) FILTER (passed IS NULL) > 0 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict, count(*) FILTER (passed) AS passed FROM g GROUP BY symbol")
def promotion_class(spark, d):
    failed, missing = F.count_if(~F.col("passed")), F.count_if(F.col("passed").isNull())
    return _gates(spark, d).groupBy("symbol").agg(F.when(failed > 0, "REJECTED").when(missing > 0, "INCONCLUSIVE").otherwise("PASS").alias("verdict"), F.count_if("passed").alias("passed"))


@q.query("cost_monotonic", f"SELECT symbol, bool_and(pnl <= before OR before IS NULL) AS monotonic FROM (SELECT symbol, pnl, lag(pnl) OVER (PARTITION BY symbol ORDER BY multiple) AS before FROM ({q.SQL['cost_stress']})) GROUP BY symbol")
def cost_monotonic(spark, d):
    from pyspark.sql import Window

    before = F.lag("pnl").over(Window.partitionBy("symbol").orderBy("multiple"))
    return q.QUERIES["cost_stress"](spark, d).withColumn("ok", F.coalesce(F.col("pnl") <= before, F.lit(True))).groupBy("symbol").agg(F.bool_and("ok").alias("monotonic"))


@q.query("limit_crossing", f"{q.WITH}, l AS (SELECT symbol, candle_index, low, lag(low) OVER s AS limit_price FROM seg {q.WIN}) SELECT symbol, count(*) FILTER (low < limit_price) AS conservative, count(*) FILTER (low <= limit_price) AS touch, count(*) AS bars FROM l WHERE limit_price IS NOT NULL GROUP BY symbol")
def limit_crossing(spark, d):
    """A buy limit at the bar before's low: crossed strictly, or touched."""
    x = q._seg(spark, d).select("symbol", "low", F.lag("low").over(q.S()).alias("limit_price")).where("limit_price IS NOT NULL")
    return x.groupBy("symbol").agg(F.count_if(F.col("low") < F.col("limit_price")).alias("conservative"), F.count_if(F.col("low") <= F.col("limit_price")).alias("touch"), F.count("*").alias("bars"))


@q.query("stream_bars_1h", f"SELECT * FROM ({b.event_bars_sql('1 hour')}) WHERE open_time + INTERVAL '1 hour' <= (SELECT date_trunc('millisecond', max(ts)) FROM events)")
def stream_bars(spark, d):
    bars = live_bars.closed_bars(live_bars.event_stream(spark, d), "1h")
    return live_bars.run_available(bars, "stream-bars").withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
