"""Gate reports of the channel breakout by symbol: its variants, folds, regimes and costs measured in one plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.functions.rounding import rounded
from barweave.operators import gates as g
from barweave.plans import queries as q
from barweave.sources.shared import written

c = F.col
#: Variants: name, kind, entry and exit channel, multiple of the cost of a turn.  Ten neighbours of the primary.
NEAR = [(15, 8), (16, 8), (18, 9), (18, 10), (19, 10), (21, 10), (22, 11), (24, 12), (25, 12), (20, 12)]
VARIANTS = [("primary", "primary", 20, 10, 1.0), ("one_half", "one_half", 20, 10, 1.5), ("double", "double", 20, 10, 2.0), *[(f"near_{a}_{b}", "neighbor", a, b, 1.0) for a, b in NEAR]]
PAIRS = sorted({v[2:4] for v in VARIANTS})
COST = 0.0025
PER = ("symbol", "variant")


def _paths(spark, d):
    """A row a bar and variant: r is what the bar adds, turns paid; held from the bar after the signal."""
    s, first = q.S(), lambda a: c("candle_index") >= a
    signal = lambda a, b: F.when(first(a) & (c("close") > F.max("high").over(s.rowsBetween(-a, -1))), 1).when(first(a) & (c("close") < F.min("low").over(s.rowsBetween(-b, -1))), 0)
    seg = q._seg(spark, d)
    fold = F.floor(c("candle_index") * 12 / F.count("*").over(Window.partitionBy("symbol"))) + 1
    x = seg.select("symbol", "candle_index", "close", fold.alias("fold"), *[signal(a, b).alias(f"s_{a}_{b}") for a, b in PAIRS])
    x = x.withColumn("s_late", F.lag("s_20_10").over(s))
    one = lambda name, kind, sig, cost: F.struct(F.lit(name).alias("variant"), F.lit(kind).alias("kind"), c(sig).alias("sig") if sig else F.lit(1).alias("sig"), F.lit(cost).alias("multiple"))
    made = [one(n, k, f"s_{a}_{b}", m) for n, k, a, b, m in VARIANTS] + [one("late", "late", "s_late", 1.0), one("hold", "hold", None, 1.0)]
    v = x.select("symbol", "candle_index", "close", "fold", F.explode(F.array(*made)).alias("v")).select("symbol", "candle_index", "close", "fold", "v.*")
    w = Window.partitionBy(*PER).orderBy("candle_index")
    v = v.withColumn("held", F.coalesce(F.last("sig", ignorenulls=True).over(w), F.lit(0)) == 1)
    v = v.withColumns({"before": F.coalesce(F.lag("held").over(w), F.lit(False)), "prev": F.lag("close").over(w)})
    gain = F.when(c("before") & (c("prev") > 0), c("close") / F.nullif(c("prev"), F.lit(0.0)) - 1).otherwise(0.0)
    return v.withColumn("r", F.ln(F.greatest(1 + gain - F.when(c("held") != c("before"), COST * c("multiple")).otherwise(0.0), F.lit(1e-9))))


def _measured(paths, *keys):
    """net_return, drawdown and their ratio of every path named by keys, from its own start."""
    w = Window.partitionBy(*keys).orderBy("candle_index").rowsBetween(Window.unboundedPreceding, 0)
    x = paths.withColumn("log", F.sum("r").over(w)).withColumn("top", F.greatest(F.lit(0.0), F.max("log").over(w)))
    m = x.groupBy(*keys).agg(F.first("kind").alias("kind"), (F.exp(F.max_by("log", "candle_index")) - 1).alias("net_return"), F.max(1 - F.exp(c("log") - c("top"))).alias("drawdown"))
    return m.withColumn("rtd", c("net_return") / F.nullif(c("drawdown"), F.lit(0.0))).withColumns({n: rounded(n) for n in ("net_return", "drawdown", "rtd")})


def _evidence(spark, d):
    """subjects with their policies, and all measures; what needs trained specialists or receipts is not given here.

    The paths are written once, as every group of measures reads them."""
    paths = written(_paths(spark, d).select("symbol", "variant", "kind", "candle_index", "fold", "r"), "gate-paths")
    whole = _measured(paths, *PER).withColumnRenamed("symbol", "subject")
    folds = _measured(paths.where(c("variant").isin("primary", "hold")), "symbol", "fold", "variant").groupBy(c("symbol").alias("subject"), "fold").pivot("variant", ["primary", "hold"]).agg(F.first("net_return").alias("net_return"), F.first("rtd").alias("rtd"))
    place = paths.where("variant = 'primary'").select(c("symbol").alias("subject"), c("candle_index").alias("exit_index"), "fold")
    gain = rounded(F.greatest(c("exit_close") - c("entry_close"), F.lit(0.0)))
    trades = q._trades(spark, d).select(c("symbol").alias("subject"), "exit_index", gain.alias("gain")).join(place, ["subject", "exit_index"])
    traded = trades.groupBy("subject", "fold").agg(F.count("*").alias("trades"), F.sum(c("gain").cast(g.VALUE)).alias("positive_profit"))
    folds = folds.join(traded, ["subject", "fold"], "left").select("subject", "fold", c("primary_net_return").alias("net_return"), c("primary_rtd").alias("rtd"), c("hold_rtd").alias("baseline_rtd"), F.coalesce("positive_profit", F.lit(0)).alias("positive_profit"), F.coalesce("trades", F.lit(0)).alias("trades"))
    state = q._regimes(spark, d)
    by_state = paths.where("variant = 'primary'").join(state, ["symbol", "candle_index"]).groupBy(c("symbol").alias("subject"), "state").agg(rounded(F.exp(F.sum("r")) - 1).alias("net_return"), F.count("*").alias("periods"))
    profit = F.sum(c("gain").cast(g.VALUE))
    sold = trades.groupBy("subject").agg(F.count("*").alias("trades"), F.nullif(profit, F.lit(0)).alias("positive_profit"), rounded(F.max("gain") / F.nullif(profit.cast("double"), F.lit(0.0))).alias("largest_trade"))
    pick = lambda variant, **names: whole.where(c("variant") == variant).select("subject", *[c(a).alias(b) for a, b in names.items()])
    final = pick("primary", net_return="net_return", drawdown="drawdown", rtd="rtd").join(pick("hold", net_return="simple_net_return", drawdown="buy_hold_drawdown", rtd="simple_rtd"), "subject").join(pick("late", rtd="delayed_rtd"), "subject").join(sold, "subject", "left")
    final = final.withColumn("trades", F.coalesce("trades", F.lit(0)))
    subjects = final.select("subject", "net_return")
    measures = (
        g.long(final, "net_return", "drawdown", "rtd", "simple_net_return", "buy_hold_drawdown", "simple_rtd", "delayed_rtd", "trades", "positive_profit", "largest_trade")
        .unionByName(g.fold_measures(subjects, folds)).unionByName(g.variant_measures(subjects, whole)).unionByName(g.regime_measures(subjects, by_state))
    )
    judged = subjects.select("subject", F.explode(F.array(*map(F.lit, g.POLICIES))).alias("policy"))
    return judged, measures


# SQL ------------------------------------------------------------------------------------------------------------
def _sig(a, b):
    return f"CASE WHEN candle_index >= {a} AND close > max(high) OVER (PARTITION BY symbol ORDER BY candle_index ROWS BETWEEN {a} PRECEDING AND 1 PRECEDING) THEN 1 WHEN candle_index >= {a} AND close < min(low) OVER (PARTITION BY symbol ORDER BY candle_index ROWS BETWEEN {b} PRECEDING AND 1 PRECEDING) THEN 0 END AS s_{a}_{b}"


_V = [(n, k, f"s_{a}_{b}", m) for n, k, a, b, m in VARIANTS] + [("late", "late", "s_late", 1.0), ("hold", "hold", "1", 1.0)]
_W = "OVER (PARTITION BY symbol, variant ORDER BY candle_index)"


def _m(name, keys):
    return f"""{name}_l AS (SELECT *, sum(r) OVER (PARTITION BY {keys} ORDER BY candle_index) AS log FROM paths), {name}_t AS (SELECT *, greatest(0, max(log) OVER (PARTITION BY {keys} ORDER BY candle_index)) AS top FROM {name}_l),
{name} AS (SELECT {keys}, kind, round(exp(arg_max(log, candle_index)) - 1, 8) AS net_return, round(max(1 - exp(log - top)), 8) AS drawdown, round((exp(arg_max(log, candle_index)) - 1) / nullif(max(1 - exp(log - top)), 0), 8) AS rtd FROM {name}_t GROUP BY {keys}, kind)"""


_LONG = {
    "final": "net_return drawdown rtd simple_net_return buy_hold_drawdown simple_rtd delayed_rtd trades positive_profit largest_trade",
    "fold_m": "folds positive_folds beaten_folds fold_concentration fold_trades",
    "var_m": "one_half_return one_half_drawdown double_return double_drawdown neighbors positive_neighbors neighbor_median neighbor_drawdown neighbor_excess",
    "reg_m": "nonnegative_regimes worst_regime",
}
_OP = {">": "value > edge", ">=": "value >= edge", "<=": "value <= edge", "=": "value = edge"}
_SQL = f"""{q._TRD}, {q._REG.split(q.WITH + ", ")[1]},
chan AS (SELECT symbol, candle_index, close, (candle_index * 12 // count(*) OVER (PARTITION BY symbol)) + 1 AS fold, {", ".join(_sig(a, b) for a, b in PAIRS)} FROM seg),
late AS (SELECT *, lag(s_20_10) OVER (PARTITION BY symbol ORDER BY candle_index) AS s_late FROM chan),
v AS ({" UNION ALL ".join(f"SELECT symbol, candle_index, close, fold, '{n}' AS variant, '{k}' AS kind, {s} AS sig, {m}::DOUBLE AS multiple FROM late" for n, k, s, m in _V)}),
vh AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) {_W}, 0) = 1 AS held FROM v), vb AS (SELECT *, coalesce(lag(held) {_W}, false) AS before, lag(close) {_W} AS prev FROM vh),
paths AS (SELECT *, ln(greatest(1 + CASE WHEN before AND prev > 0 THEN close / prev - 1 ELSE 0 END - CASE WHEN held <> before THEN {COST} * multiple ELSE 0 END, 1e-9)) AS r FROM vb),
{_m("whole", "symbol, variant")}, {_m("parts", "symbol, fold, variant")},
sold AS (SELECT t.symbol, p.fold, round(greatest(exit_close - entry_close, 0), 8) AS gain FROM trades t JOIN chan p ON p.symbol = t.symbol AND p.candle_index = t.exit_index),
sold_f AS (SELECT symbol, fold, count(*) AS trades, sum(gain) AS profit FROM sold GROUP BY ALL), sold_s AS (SELECT symbol, count(*) AS trades, nullif(sum(gain), 0) AS positive_profit, round(max(gain) / nullif(sum(gain), 0), 8) AS largest_trade FROM sold GROUP BY ALL),
folds AS (SELECT p.symbol, p.fold, p.net_return, p.rtd, h.rtd AS baseline_rtd, coalesce(s.profit, 0) AS profit, coalesce(s.trades, 0) AS trades FROM parts p JOIN parts h ON h.symbol = p.symbol AND h.fold = p.fold AND h.variant = 'hold' LEFT JOIN sold_f s ON s.symbol = p.symbol AND s.fold = p.fold WHERE p.variant = 'primary'),
fold_m AS (SELECT symbol, count(*) AS folds, avg((net_return > 0)::INT) AS positive_folds, CASE WHEN bool_or(rtd IS NULL OR baseline_rtd IS NULL) THEN NULL ELSE avg((rtd > baseline_rtd)::INT) END AS beaten_folds, coalesce(max(profit) / nullif(sum(profit), 0), 1) AS fold_concentration, sum(trades) AS fold_trades FROM folds GROUP BY symbol),
final AS (SELECT w.symbol, w.net_return, w.drawdown, w.rtd, h.net_return AS simple_net_return, h.drawdown AS buy_hold_drawdown, h.rtd AS simple_rtd, l.rtd AS delayed_rtd, coalesce(s.trades, 0) AS trades, s.positive_profit, s.largest_trade FROM whole w JOIN whole h ON h.symbol = w.symbol AND h.variant = 'hold' JOIN whole l ON l.symbol = w.symbol AND l.variant = 'late' LEFT JOIN sold_s s ON s.symbol = w.symbol WHERE w.variant = 'primary'),
var_m AS (SELECT w.symbol, max(w.net_return) FILTER (kind = 'one_half') AS one_half_return, max(w.drawdown) FILTER (kind = 'one_half') AS one_half_drawdown, max(w.net_return) FILTER (kind = 'double') AS double_return, max(w.drawdown) FILTER (kind = 'double') AS double_drawdown,
 count(*) FILTER (kind = 'neighbor') AS neighbors, count(*) FILTER (kind = 'neighbor' AND w.net_return > 0) AS positive_neighbors, quantile_cont(w.net_return, 0.5) FILTER (kind = 'neighbor') AS neighbor_median, max(w.drawdown) FILTER (kind = 'neighbor') AS neighbor_drawdown,
 CASE WHEN any_value(f.net_return) > 0.02 THEN 0 ELSE max(w.net_return) FILTER (kind = 'neighbor') - 2 * any_value(f.net_return) END AS neighbor_excess FROM whole w JOIN final f USING (symbol) GROUP BY w.symbol),
reg AS (SELECT p.symbol, r.state, round(exp(sum(p.r)) - 1, 8) AS net_return FROM paths p JOIN regime r ON r.symbol = p.symbol AND r.candle_index = p.candle_index WHERE p.variant = 'primary' GROUP BY ALL),
reg_m AS (SELECT symbol, count(*) FILTER (r.net_return >= 0) AS nonnegative_regimes, coalesce(min(r.net_return), 0) AS worst_regime FROM final f LEFT JOIN reg r USING (symbol) GROUP BY symbol),
measures AS ({" UNION ALL ".join(f"SELECT symbol AS subject, '{n}' AS measure, {n}::DOUBLE AS value FROM {t}" for t, names in _LONG.items() for n in names.split())}),
gates AS (SELECT * FROM (VALUES {", ".join(str(r).replace("None", "NULL") for r in g.condition_rows())}) t(policy, position, gate, measure, comparison, bound, factor, comparator, absent)),
cond AS (SELECT f.symbol AS subject, x.*, a.value, bound::DOUBLE + CASE WHEN comparator IS NULL THEN 0 ELSE factor::DOUBLE * b.value END AS edge FROM final f, gates x LEFT JOIN measures a ON a.subject = f.symbol AND a.measure = x.measure LEFT JOIN measures b ON b.subject = f.symbol AND b.measure = x.comparator),
told AS (SELECT *, CASE comparison {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _OP.items())} END AS holds FROM cond),
outcomes AS (SELECT subject, policy, position, gate, round(arg_min(value, measure), 6) AS observed, CASE WHEN bool_or(holds IS NULL AND absent = 'missing') THEN 'MISSING' WHEN bool_or(CASE WHEN holds IS NULL THEN absent = 'fail' ELSE NOT holds END) THEN 'FAILED' ELSE 'PASSED' END AS status FROM told GROUP BY ALL)"""


@q.query("gates_report", f"{_SQL} SELECT * FROM outcomes")
def gates_report(spark, d):
    """32, 26 and 27 gates a symbol under the three policies."""
    return _outcomes(spark, d).withColumn("observed", rounded(c("observed").cast("double"), 6))


@q.query("gates_verdict", f"{_SQL} SELECT subject, policy, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'MISSING') AS missing, CASE WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'REJECTED' WHEN count(*) FILTER (status = 'MISSING') > 0 THEN 'INCONCLUSIVE' WHEN policy = 'v0.1' THEN 'PASS' ELSE 'QUALIFIED' END AS verdict FROM outcomes GROUP BY subject, policy")
def gates_verdict(spark, d):
    return g.verdict(_outcomes(spark, d))


def _outcomes(spark, d):
    judged, measures = _evidence(spark, d)
    return g.evaluate(judged, measures, g.gate_table(spark))
