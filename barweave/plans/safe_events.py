"""Events of schedules that hold nothing across a segment boundary or a gap: a gated baseline, and specialists alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators.schedules import boundary_safe_events, next_boundary
from barweave.plans import queries as q
from barweave.plans.specialist import bundle
from barweave.sources import bars as b

LATENCY = 1
ENTER_AT, EXIT_AT = 0.62, 0.45

#: Every boundary after an event takes it away if it lies past the last safe decision; the walk itself is recursive.
_SAFE = f"""WITH RECURSIVE {q._DON.split("WITH ", 1)[1]}, {q._REG.split(q.BASE, 1)[0]}{q.BASE.split(q.WITH + ", ", 1)[1]}, {q._REG.split(q.BASE + ", ", 1)[1]},
d AS (SELECT symbol || '/' || gate AS series, symbol, gate, candle_index AS i, segment AS g, held AND (gate = 'ANY' OR coalesce(state = gate, false)) AS up, NOT held OR NOT (gate = 'ANY' OR coalesce(state = gate, false)) AS down
 FROM sched JOIN seg USING (symbol, candle_index) LEFT JOIN regime USING (symbol, candle_index), (VALUES ('ANY'), ('TRENDING'), ('RANGING')) gates(gate) WHERE hour(open_time) <> 3),
r AS MATERIALIZED (SELECT *, row_number() OVER s AS k, lag(i) OVER s AS pi, lag(g) OVER s AS pg, max(i) OVER (PARTITION BY series) AS last FROM d WINDOW s AS (PARTITION BY series ORDER BY i)),
walk AS (SELECT series, k, i, g, pi, pg, last, false AS was, up AS held, false AS closed FROM r WHERE k = 1
 UNION ALL SELECT r.series, r.k, r.i, r.g, r.pi, r.pg, r.last, w.held AND r.g = r.pg AND r.i = r.pi + 1, CASE WHEN r.up THEN true WHEN r.down THEN false ELSE w.held AND r.g = r.pg AND r.i = r.pi + 1 END, w.held AND r.g = r.pg AND r.i <> r.pi + 1 FROM walk w JOIN r ON r.series = w.series AND r.k = w.k + 1),
raw AS (SELECT series, i, 'ENTER' AS action FROM walk WHERE held AND NOT was UNION ALL SELECT series, i, 'EXIT' FROM walk WHERE was AND NOT held
 UNION ALL SELECT series, pi, 'GAP' FROM walk WHERE closed UNION ALL SELECT series, i, 'EXIT' FROM walk WHERE held AND i = last),
per_bar AS (SELECT series, i, CASE WHEN bool_or(action = 'GAP') THEN CASE WHEN bool_or(action = 'ENTER') THEN NULL ELSE 'EXIT' END ELSE max(action) END AS action FROM raw GROUP BY series, i),
bound AS (SELECT symbol, min(candle_index) AS b FROM seg WHERE segment > 0 GROUP BY symbol, segment),
near AS (SELECT series, b, b - 2 - {LATENCY} AS safe, coalesce(lag(b) OVER (PARTITION BY series ORDER BY b), 0) AS after FROM bound JOIN (SELECT series, symbol, max(i) AS last FROM d GROUP BY ALL) USING (symbol) WHERE b <= last + 1 + {LATENCY}),
kept AS (SELECT o.* FROM per_bar o WHERE action IS NOT NULL AND NOT EXISTS (SELECT 1 FROM near n WHERE n.series = o.series AND n.b > o.i AND n.safe < o.i)),
ends AS (SELECT n.series, n.safe, arg_max(k.action, k.i) AS action, max(k.i) AS i FROM near n JOIN kept k ON k.series = n.series AND k.i <= n.safe AND k.i >= n.after GROUP BY n.series, n.safe)
SELECT split_part(series, '/', 1) AS symbol, split_part(series, '/', 2) AS gate, i AS candle_index, action FROM kept WHERE NOT (action = 'ENTER' AND EXISTS (SELECT 1 FROM near n WHERE n.series = kept.series AND n.safe = kept.i))
UNION ALL SELECT split_part(series, '/', 1), split_part(series, '/', 2), safe, 'EXIT' FROM ends WHERE action = 'ENTER' AND i < safe"""


@q.query("safe_baseline_events", _SAFE)
def safe_baseline_events(spark, d):
    """The breakout baseline in any regime, and where bars trend or range only, over decisions outside of the nightly hour;
    a schedule that already holds when its regime begins enters then.  Bars without a regime are in none."""
    seg = q._seg(spark, d)
    rows = q._donchian(spark, d).select("symbol", "candle_index", "open_time", "segment", "held").join(q._regimes(spark, d), ["symbol", "candle_index"], "left")
    rows = rows.where(F.hour("open_time") != 3).join(next_boundary(seg, ["symbol"]), ["symbol", "segment"])
    rows = rows.withColumn("gate", F.explode(F.array(*map(F.lit, ("ANY", "TRENDING", "RANGING")))))
    allowed = (F.col("gate") == "ANY") | F.coalesce(F.col("state") == F.col("gate"), F.lit(False))
    rows = rows.select("symbol", "gate", "candle_index", "segment", "boundary", (F.col("held") & allowed).alias("up"), (~F.col("held") | ~allowed).alias("down"))
    return boundary_safe_events(rows, ["symbol", "gate"], LATENCY)


@q.query("specialist_threshold_events")
def specialist_threshold_events(spark, d):
    """Each specialist by itself on the rows of a fold that test: it enters at ENTER_AT in its own regime and leaves at
    EXIT_AT or where the regime ends; the third variant enters ranging bars only where they are stretched."""
    made = bundle(spark, d)
    rows = made["rows"].where("role = 'test'")
    bounds = next_boundary(b.segmented(made["bars"], "INTERVAL '1' DAY"), ["symbol"])
    trend, range_ = F.col("state") == "TRENDING", F.col("state") == "RANGING"
    variants = [("trend", F.col("p_trend"), trend), ("mean", F.col("p_mean"), range_), ("mean_stretched", F.col("p_mean"), range_ & F.col("stretch"))]
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("specialist"), p.alias("p"), a.alias("allowed")) for n, p, a in variants])).alias("v")
    rows = rows.select("fold", "symbol", "candle_index", "segment", cases).join(bounds, ["symbol", "segment"])
    up, down = F.col("v.allowed") & (F.col("v.p") >= ENTER_AT), ~F.col("v.allowed") | (F.col("v.p") <= EXIT_AT)
    rows = rows.select("fold", "symbol", F.col("v.specialist").alias("specialist"), "candle_index", "segment", "boundary", up.alias("up"), down.alias("down"))
    return boundary_safe_events(rows, ["fold", "symbol", "specialist"])
