"""Gates as rows: conditions joined to long measures, three-valued, and the verdict of a subject under a policy.

A condition compares a measure with bound + factor * comparator.  A gate may have several conditions.  It is MISSING if any
of them lacks a value (unless its row says that absence fails or passes; a return of -1 or more only asks that it is there), else FAILED if any does not hold, else PASSED.
One failed gate rejects, whatever else is missing; without a failure, a missing gate leaves the verdict INCONCLUSIVE.
Values are decimals of 12 places, so that a bound that is met exactly passes.  No gate is in the code of the plan: other
policies are other rows of the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The policies' gates in their order.
_DEVELOPMENT = "development.fold_count development.positive_return_folds development.baseline_rtd_folds development.profit_concentration development.trade_count"
_FINAL = (
    "final.net_return final.trade_count final.absolute_drawdown final.relative_drawdown final.return_to_drawdown final.simple_baseline_rtd final.specialist_rtd "
    "final.simple_baseline_net_return final.trade_concentration final.regime_nonnegative final.regime_loss"
)
_COST = "cost.one_half_return cost.one_half_drawdown cost.double_return cost.double_drawdown cost.monotonicity"
_SENSITIVITY = "sensitivity.positive_neighbors sensitivity.median_return sensitivity.drawdown sensitivity.primary_stability"
_UNCERTAINTY = "uncertainty.bootstrap_median uncertainty.bootstrap_lower_bound"
_SHUFFLED = "control.shuffled_labels control.delayed_features"
_ABLATED = "control.no_volume control.no_protection"
POLICIES = {
    "v0.1": f"{_DEVELOPMENT} {_FINAL} {_COST} {_SENSITIVITY} {_UNCERTAINTY} {_SHUFFLED} control.no_disagreement {_ABLATED}".split(),
    "v0.2": f"integrity.verified convergence.trend_determinism calibration.complete {_DEVELOPMENT} {_SHUFFLED} control.no_disagreement {_ABLATED} {_COST} {_SENSITIVITY} {_UNCERTAINTY} replay.verified independent.verified".split(),
    "v0.3": f"integrity.verified convergence.trend_determinism calibration.complete selectivity.replay {_DEVELOPMENT} {_SHUFFLED} control.no_percentile_selectivity {_ABLATED} {_COST} {_SENSITIVITY} {_UNCERTAINTY} replay.verified independent.verified".split(),
}

# Gate, policies, measure, comparison, bound, factor and comparator (- for none), what absence means.
CONDITIONS = """
integrity.verified                   23   integrity                = 1       0     -                  missing
convergence.trend_determinism        23   trend_determinism        = 1       0     -                  missing
calibration.complete                 23   calibration              = 1       0     -                  missing
selectivity.replay                   3    selectivity_replay       = 1       0     -                  missing
replay.verified                      23   replay                   = 1       0     -                  missing
independent.verified                 23   independent              = 1       0     -                  missing
development.fold_count               1    folds                    >= 5      0     -                  missing
development.fold_count               23   folds                    = 12      0     -                  missing
development.positive_return_folds    123  positive_folds           >= 0.60   0     -                  missing
development.baseline_rtd_folds       123  beaten_folds             >= 0.60   0     -                  missing
development.profit_concentration     123  fold_concentration       <= 0.50   0     -                  missing
development.trade_count              123  fold_trades              >= 60     0     -                  missing
final.net_return                     1    net_return               > 0       0     -                  missing
final.trade_count                    1    trades                   >= 30     0     -                  missing
final.absolute_drawdown              1    drawdown                 <= 0.25   0     -                  missing
final.relative_drawdown              1    drawdown                 <= 0      0.80  buy_hold_drawdown  missing
final.return_to_drawdown             1    rtd                      >= 0.50   0     -                  missing
final.simple_baseline_rtd            1    rtd                      >= 0      1.10  simple_rtd         missing
final.specialist_rtd                 1    rtd                      >= 0      1.05  specialist_rtd     missing
final.simple_baseline_net_return     1    net_return               >= -0.02  1     simple_net_return  missing
final.trade_concentration            1    largest_trade            <= 0.25   0     -                  missing
final.regime_nonnegative             1    nonnegative_regimes      >= 2      0     -                  missing
final.regime_loss                    1    worst_regime             >= 0      -0.25 positive_profit    missing
cost.one_half_return                 123  one_half_return          > 0       0     -                  missing
cost.one_half_drawdown               123  one_half_drawdown        <= 0.275  0     -                  missing
cost.double_return                   123  double_return            >= -0.05  0     -                  missing
cost.double_drawdown                 123  double_drawdown          <= 0.30   0     -                  missing
cost.monotonicity                    123  net_return               >= 0      1     one_half_return    missing
cost.monotonicity                    123  one_half_return          >= 0      1     double_return      missing
sensitivity.positive_neighbors       1    positive_neighbors       >= 7      0     -                  fail
sensitivity.positive_neighbors       1    neighbors                >= 10     0     -                  fail
sensitivity.positive_neighbors       23   positive_neighbors       >= 7      0     -                  missing
sensitivity.positive_neighbors       23   neighbors                = 10      0     -                  missing
sensitivity.median_return            1    neighbor_median          > 0       0     -                  fail
sensitivity.median_return            23   neighbor_median          > 0       0     -                  missing
sensitivity.drawdown                 1    neighbor_drawdown        <= 0.35   0     -                  fail
sensitivity.drawdown                 23   neighbor_drawdown        <= 0.35   0     -                  missing
sensitivity.primary_stability        1    neighbor_excess          <= 0      0     -                  pass
sensitivity.primary_stability        1    net_return               >= -1     0     -                  missing
sensitivity.primary_stability        23   neighbor_excess          <= 0      0     -                  missing
uncertainty.bootstrap_median         123  bootstrap_median         > 0       0     -                  missing
uncertainty.bootstrap_lower_bound    123  bootstrap_p05            > -0.02   0     -                  missing
control.shuffled_labels              123  shuffled_economic        = 0       0     -                  missing
control.delayed_features             1    delayed_rtd              <= 0      1.05  rtd                missing
control.delayed_features             23   delayed_supported        = 1       0     -                  missing
control.no_disagreement              12   disagreement_supported   = 1       0     -                  missing
control.no_percentile_selectivity    3    selectivity_supported    = 1       0     -                  missing
control.no_volume                    123  volume_supported         = 1       0     -                  missing
control.no_protection                123  protection_supported     = 1       0     -                  missing
"""

VALUE = "decimal(32,12)"
SCHEMA = "policy string, position int, gate string, measure string, comparison string, bound string, factor string, comparator string, absent string"


def condition_rows() -> list[tuple]:
    """The fixed conditions, one tuple a policy, gate and condition, as SCHEMA names them."""
    made = []
    for line in CONDITIONS.strip().splitlines():
        gate, policies, measure, comparison, bound, factor, comparator, absent = line.split()
        for policy in (f"v0.{n}" for n in policies):
            made.append((policy, POLICIES[policy].index(gate) + 1, gate, measure, comparison, bound, factor, None if comparator == "-" else comparator, absent))
    return made


def gate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(condition_rows(), SCHEMA)


def long(rows: DataFrame, *measures: str) -> DataFrame:
    """(subject, measure, value) from a row a subject; booleans count 1 and 0, nulls are left out."""
    entry = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast(VALUE).alias("value")) for m in measures])).alias("e")
    return rows.select("subject", entry).select("subject", "e.*").where("value IS NOT NULL")


def component_supported(rtd: Column, drawdown: Column, ablated_rtd: Column, ablated_drawdown: Column, lower: bool = False) -> Column:
    """Whether a component stays supported: its ablation must not gain 10 % in return to drawdown at a drawdown that is no
    higher (lower: that is lower).  Null without either drawdown; false where a ratio is undefined."""
    gains = ablated_rtd >= F.lit("1.10").cast("decimal(4,2)") * rtd
    calmer = ablated_drawdown < drawdown if lower else ablated_drawdown <= drawdown
    undefined = rtd.isNull() | ablated_rtd.isNull()
    return F.when(drawdown.isNull() | ablated_drawdown.isNull(), None).when(undefined, False).otherwise(~(gains & calmer))


def economic(net_return: Column, rtd: Column, simple_rtd: Column, specialist_rtd: Column) -> Column:
    """Whether a negative control shows any economic gate passed: it should not."""
    times = lambda f, x: F.coalesce(rtd >= F.lit(f).cast("decimal(4,2)") * x, F.lit(False))
    return F.coalesce(net_return > 0, F.lit(False)) | F.coalesce(rtd >= F.lit("0.50").cast("decimal(4,2)"), F.lit(False)) | times("1.10", simple_rtd) | times("1.05", specialist_rtd)


def fold_measures(subjects: DataFrame, folds: DataFrame) -> DataFrame:
    """Measures of development folds (subject, fold, net_return, rtd, baseline_rtd, positive_profit, trades).

    A fold without either ratio leaves beaten_folds out; no profit at all counts as concentration 1; a subject without folds
    has none of them, zero of each share and concentration 1.
    """
    exact = lambda name: F.col(name).cast(VALUE)
    gain = F.greatest(exact("positive_profit"), F.lit(0).cast(VALUE))
    ratio = F.coalesce(F.col("rtd").isNull() | F.col("baseline_rtd").isNull(), F.lit(True))
    per = folds.groupBy("subject").agg(
        F.count("*").alias("n"), F.count_if(F.col("net_return") > 0).alias("positive"), F.count_if(ratio).alias("unknown"),
        F.count_if(exact("rtd") > exact("baseline_rtd")).alias("beaten"), F.max(exact("positive_profit")).alias("most"), F.sum(gain).alias("all"), F.sum("trades").alias("fold_trades"),
    )
    n = F.nullif(F.coalesce("n", F.lit(0)), F.lit(0))
    share = lambda name: F.coalesce(F.col(name) / n, F.lit(0.0))
    x = subjects.select("subject").distinct().join(per, "subject", "left").select(
        "subject", F.coalesce("n", F.lit(0)).alias("folds"), share("positive").alias("positive_folds"),
        F.when(F.coalesce("unknown", F.lit(0)) == 0, share("beaten")).alias("beaten_folds"),
        F.coalesce(F.col("most").cast("double") / F.nullif(F.col("all").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("fold_concentration"), F.coalesce("fold_trades", F.lit(0)).alias("fold_trades"),
    )
    return long(x, "folds", "positive_folds", "beaten_folds", "fold_concentration", "fold_trades")


def variant_measures(subjects: DataFrame, variants: DataFrame, neighbor: str = "neighbor") -> DataFrame:
    """Measures of cost and neighbour variants (subject, kind, net_return, drawdown) beside subjects (subject, net_return).

    kind is one_half, double or that of the neighbours.  neighbor_excess is what the best neighbour returns beyond twice the
    primary's return, zero where that is above 0.02.  Without neighbours none of their measures is given.  Their count is small
    (a variant each), so the exact median gathers a few values.
    """
    is_near = F.col("kind") == neighbor
    net = F.col("net_return").cast(VALUE)
    per = variants.groupBy("subject").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(c).cast(VALUE))).alias(f"{k}_{to}") for k in ("one_half", "double") for c, to in (("net_return", "return"), ("drawdown", "drawdown"))],
        F.nullif(F.count_if(is_near), F.lit(0)).alias("neighbors"), F.count_if(is_near & (net > 0)).alias("_positive"), F.max(F.when(is_near, net)).alias("_best"),
        F.percentile(F.when(is_near, net), 0.5).alias("neighbor_median"), F.max(F.when(is_near, F.col("drawdown").cast(VALUE))).alias("neighbor_drawdown"),
    )
    x = subjects.select("subject", net.alias("_net")).join(per, "subject", "left")
    excess = F.when(F.col("_net") > F.lit("0.02").cast(VALUE), F.lit(0).cast(VALUE)).otherwise(F.col("_best") - 2 * F.col("_net"))
    x = x.withColumns({"positive_neighbors": F.when(F.col("neighbors") > 0, F.col("_positive")), "neighbor_excess": F.when(F.col("neighbors") > 0, excess)})
    return long(x, "one_half_return", "one_half_drawdown", "double_return", "double_drawdown", "neighbors", "positive_neighbors", "neighbor_median", "neighbor_drawdown", "neighbor_excess")


def regime_measures(subjects: DataFrame, regimes: DataFrame) -> DataFrame:
    """Measures of regimes (subject, net_return, periods): those with periods that lose nothing, and the worst (none: 0)."""
    seen, net = F.col("periods") > 0, F.col("net_return").cast(VALUE)
    per = regimes.groupBy("subject").agg(F.count_if(seen & (net >= 0)).alias("k"), F.min(F.when(seen, net)).alias("w"))
    x = subjects.select("subject").distinct().join(per, "subject", "left").select("subject", F.coalesce("k", F.lit(0)).alias("nonnegative_regimes"), F.coalesce("w", F.lit(0).cast(VALUE)).alias("worst_regime"))
    return long(x, "nonnegative_regimes", "worst_regime")


def receipt_measures(fits: DataFrame, replays: DataFrame, folds: int = 12) -> DataFrame:
    """trend_determinism of repeated fits (subject, fold, exact, iterations) and selectivity_replay of replayed entry
    thresholds (subject, fold, specialist, percentile, exact).

    Fits hold if the folds are 1 to 12, once each, all exact in under 50000 iterations.  Replays count at the 75th percentile:
    24 of them, one a fold and specialist, else the inventory is incomplete and the measure is not given.
    """
    whole = (F.count("*") == folds) & (F.count_distinct("fold") == folds) & (F.min("fold") == 1) & (F.max("fold") == folds)
    right = F.coalesce(F.col("exact") & (F.col("iterations") < 50000), F.lit(False))
    fit = fits.groupBy("subject").agg((whole & F.bool_and(right)).alias("trend_determinism"))
    listed = F.col("fold").between(1, folds) & F.col("specialist").isin("trend", "mean_reversion")
    entry = F.struct("fold", "specialist")
    full = (F.count("*") == 2 * folds) & (F.count_distinct(entry) == 2 * folds) & F.bool_and(listed)
    replay = replays.where(F.col("percentile") == 75).groupBy("subject").agg(F.when(full, F.bool_and(F.coalesce("exact", F.lit(False)))).alias("selectivity_replay"))
    return long(fit, "trend_determinism").unionByName(long(replay, "selectivity_replay"))


def evaluate(subjects: DataFrame, measures: DataFrame, gates: DataFrame) -> DataFrame:
    """One row a subject, policy and gate: position, observed (the first condition's measure) and status.

    subjects (subject, policy) says which policy judges what; measures is (subject, measure, value), a measure given twice for a
    subject is an error, one of another name is ignored, null or not given means missing.  gates is the small condition table.
    """
    named = gates.select(F.col("measure").alias("m")).unionByName(gates.select(F.col("comparator").alias("m"))).where("m IS NOT NULL").distinct()
    known = measures.join(F.broadcast(named), measures["measure"] == named["m"], "left_semi").where("value IS NOT NULL")
    held = known.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.col("value").cast(VALUE)))).alias("held"))
    x = subjects.select("subject", "policy").distinct().join(held, "subject", "left").join(F.broadcast(gates), "policy")
    value, other = F.col("held")[F.col("measure")], F.col("held")[F.col("comparator")]
    edge = F.col("bound").cast(VALUE) + F.when(F.col("comparator").isNull(), F.lit(0).cast(VALUE)).otherwise(other) * F.col("factor").cast("decimal(4,2)")
    op = F.col("comparison")
    holds = F.when(op == ">", value > edge).when(op == ">=", value >= edge).when(op == "<", value < edge).when(op == "<=", value <= edge).when(op == "=", value == edge)
    told = x.select("subject", "policy", "position", "gate", "measure", "absent", value.alias("value"), holds.alias("holds"))
    lacks = F.count_if(F.col("holds").isNull() & (F.col("absent") == "missing")) > 0
    fails = F.count_if(F.when(F.col("holds").isNull(), F.col("absent") == "fail").otherwise(~F.col("holds"))) > 0
    status = F.when(lacks, "MISSING").when(fails, "FAILED").otherwise("PASSED").alias("status")
    return told.groupBy("subject", "policy", "position", "gate").agg(F.min_by("value", "measure").alias("observed"), status)


def verdict(outcomes: DataFrame) -> DataFrame:
    """A row a subject and policy: how many gates passed, failed and are missing, and what follows."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    x = outcomes.groupBy("subject", "policy").agg(n("PASSED"), n("FAILED"), n("MISSING"))
    good = F.when(F.col("policy") == "v0.1", "PASS").otherwise("QUALIFIED")
    return x.withColumn("verdict", F.when(F.col("failed") > 0, "REJECTED").when(F.col("missing") > 0, "INCONCLUSIVE").otherwise(good))
