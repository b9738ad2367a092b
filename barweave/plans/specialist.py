"""Queries of the specialists: their design matrix over the walk-forward folds of daily bars, models as tables, and the
fold bundle that arbitration reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions import features as ft
from barweave.operators import specialists as sp
from barweave.plans import queries as q
from barweave.sources import bars as b
from barweave.sources.shared import written

_NAMES = list(ft.registry_sql())
#: Returns, momentum, trend, volatility and volume; mean reversion, candle shape, volatility and volume.
TREND = [n for f in ("returns", "momentum", "ema", "ema_slope", "volatility", "volume") for n in ft.names_of(f) if n != "volatility_ratio_6_42"]
MEAN = [n for f in ("mean_reversion", "candle_shape", "volatility", "volume") for n in ft.names_of(f) if n != "volatility_ratio_6_42"]
#: As many as the policy has; each takes two passes.
TREES = 150
STRETCH = "close_zscore_24 <= -0.75 OR drawdown_from_high_24 >= 0.02"
ROLE = "CASE WHEN candle_index + 4 < c0 - 3 THEN 'train' WHEN candle_index >= c0 + 3 AND candle_index + 4 < c1 - 3 THEN 'calibrate' WHEN candle_index >= c1 + 3 AND candle_index + 4 < c2 - 3 THEN 'test' END"


def _daily(spark, d):
    """Daily bars, written: the features, labels and bounds of a fold all read them, and so line items are read once."""
    return written(b.item_bars(spark, d), "bars")


def panel(spark, d, bars=None):
    """Bars with all features and a label, once for each fold that trains, calibrates or tests on them; folds pool the
    symbols, each with its own bounds, and a row's label ends three bars before its window does."""
    bars = _daily(spark, d) if bars is None else bars
    seg = b.segmented(bars, "INTERVAL '1' DAY")
    made = ft.registry()
    rows = ft.base(seg).select("symbol", "segment", "candle_index", "close", "low", F.col("atr24").alias("atr"), *[c.alias(n) for n, c in made.items()]).dropna()
    rows = written(rows, "features")  # planning joins over all these expressions takes longer than all else
    labels = q._labels(spark, d, seg).select("symbol", "candle_index", "gross_return", (F.col("net_return") > q.HURDLE).alias("positive"))
    each = rows.join(labels, ["symbol", "candle_index"]).join(q._folds(spark, d, bars), "symbol")
    return each.withColumns({"role": F.expr(ROLE), "stretch": F.expr(STRETCH)}).where("role IS NOT NULL").drop("c0", "c1", "c2")


_DAILY = b.SEGMENTED_SQL.replace(b.event_bars_sql("1 hour"), b.ITEM_BARS_SQL).replace("INTERVAL '1 hour'", "INTERVAL '1 day'")
_PANEL = f"""WITH {_DAILY}, {ft.base_sql()}, x AS (SELECT symbol, candle_index, {", ".join(f"{e} AS {n}" for n, e in ft.registry_sql().items())} FROM base),
{q._LAB[len(q.WITH) + 2 :]}, {q._FOLD[len("WITH ") :]},
panel AS (SELECT x.*, net_return > {q.HURDLE} AS positive, fold, {ROLE} AS role, {STRETCH} AS stretch FROM x JOIN net USING (symbol, candle_index) JOIN folds USING (symbol) WHERE {" AND ".join(f"{n} IS NOT NULL" for n in _NAMES)})"""


@q.query(
    "specialist_panel",
    f"""{_PANEL} SELECT fold, role, count(*) AS n, sum(positive::INT)::BIGINT AS n_positive, sum(stretch::INT)::BIGINT AS n_stretch,
 round(CASE WHEN avg(positive::INT) BETWEEN 0.3 AND 0.7 THEN 1.0 ELSE count(*) / nullif(2.0 * sum(positive::INT), 0) END, 8) AS weight_positive FROM panel WHERE role IS NOT NULL GROUP BY fold, role""",
)
def specialist_panel(spark, d):
    hits = F.sum(F.col("positive").cast("bigint"))
    weight = F.when((hits / F.count("*")).between(0.3, 0.7), 1.0).otherwise(F.count("*") / F.nullif(2.0 * hits, F.lit(0.0)))
    return panel(spark, d).groupBy("fold", "role").agg(F.count("*").alias("n"), hits.alias("n_positive"), F.count_if("stretch").alias("n_stretch"), q._r(weight).alias("weight_positive"))


_MADE: dict[tuple[str, str], dict] = {}


def bundle(spark, d) -> dict:
    """Models and what they say, by name: daily bars, scales, linear model, trees, calibrations, return maps and predictions of the
    rows that calibrate and test.  Made once a session and folder, and kept as written tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MADE:
        train, bars = F.col("role") == "train", _daily(spark, d)
        rows, trend_scales = sp.standardised(written(panel(spark, d, bars), "panel"), TREND, train)
        linear = written(sp.elastic_net(written(rows.where(train).select("fold", "positive", "weight", "x"), "train"), TREND), "linear")
        rows = sp.linear_scores(rows, linear, "trend_raw").drop("x", "weight")
        low = train & F.col("stretch")
        rows, mean_scales = sp.standardised(rows, MEAN, low)
        nodes = written(sp.boosted_trees(written(rows.where(low).select("fold", "positive", "weight", "x"), "train"), MEAN, trees=TREES), "trees")
        rows = sp.tree_scores(rows.where(~train), nodes, name="mean_raw")
        state = q.regime_of("volatility_ratio_6_42", "true_range_ratio_24", "trend_strength_12_42_atr24", "ema_12_42_sign_streak")
        rows = written(rows.withColumn("state", state).drop("x", "weight", *_NAMES), "scored")
        out = {"bars": bars, "trend_scales": trend_scales, "mean_scales": mean_scales, "linear": linear, "trees": nodes}
        for kind in ("trend", "mean"):
            fits = written(sp.platt(rows.where("role = 'calibrate'").select("fold", F.col(f"{kind}_raw").alias("score"), "positive")), "platt")
            rows = sp.calibrated(rows, fits, f"{kind}_raw", f"p_{kind}")
            maps = sp.return_maps(rows.where("role = 'calibrate'"), f"p_{kind}")
            rows = sp.expected(rows, maps, f"p_{kind}", f"e_{kind}")
            out |= {f"{kind}_platt": fits, f"{kind}_map": maps}
        out["rows"] = written(rows, "predictions")
        _MADE[key] = out
    return _MADE[key]


@q.query("trend_model")
def trend_model(spark, d):
    """Feature, mean, scale and coefficient of each fold's linear model; the intercept has no mean or scale."""
    made = bundle(spark, d)
    told = F.arrays_zip(F.col("names").alias("feature"), F.col("means").alias("mean"), F.col("scales").alias("scale"), F.col("coefficients").alias("coefficient"))
    each = made["linear"].join(made["trend_scales"], "fold").select("fold", F.explode(told).alias("f")).select("fold", "f.*")
    last = made["linear"].select("fold", F.lit("(intercept)").alias("feature"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("scale"), F.col("intercept").alias("coefficient"))
    return each.unionByName(last).withColumn("coefficient", q._r(F.col("coefficient"), 6))


@q.query("mean_reversion_trees")
def mean_reversion_trees(spark, d):
    return bundle(spark, d)["trees"]


@q.query("fold_predictions")
def fold_predictions(spark, d):
    """What the specialists say of each row that tests."""
    made = bundle(spark, d)["rows"].where("role = 'test'")
    return made.select("fold", "symbol", "candle_index", "state", *[q._r(F.col(c)).alias(c) for c in ("trend_raw", "mean_raw", "p_trend", "p_mean", "e_trend", "e_mean")])


@q.query("fold_calibration")
def fold_calibration(spark, d):
    """Calibration, return map and diagnostics on the calibration rows of each fold and specialist."""
    made, parts = bundle(spark, d), []
    y = F.col("positive").cast("double")
    for kind in ("trend", "mean"):
        p = F.col(f"p_{kind}")
        clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
        loss = F.avg(F.when(F.col("positive"), -F.ln(clipped)).otherwise(-F.ln(1 - clipped)))
        seen = made["rows"].where("role = 'calibrate'").groupBy("fold").agg(F.avg(F.pow(p - y, F.lit(2))).alias("brier"), loss.alias("log_loss"))
        maps = made[f"{kind}_map"].select("fold", F.col("slope").alias("return_slope"), F.col("intercept").alias("return_intercept"))
        parts.append(made[f"{kind}_platt"].join(maps, "fold").join(seen, "fold").withColumn("specialist", F.lit(kind)))
    both = parts[0].unionByName(parts[1])
    return both.select("fold", "specialist", "n", "n_positive", *[q._r(F.col(c), 6).alias(c) for c in ("slope", "intercept", "low", "high", "return_slope", "return_intercept", "brier", "log_loss")])


@q.query("fold_entry_thresholds")
def fold_entry_thresholds(spark, d):
    """Three percentiles a fold and specialist over calibration rows in its regime; folds with under 40 of them are left out."""
    rows, parts = bundle(spark, d)["rows"].where("role = 'calibrate'"), []
    for kind, state in (("trend", "TRENDING"), ("mean", "RANGING")):
        enough = rows.where(F.col("state") == state).groupBy("fold").agg(F.count("*").alias("k")).where("k >= 40").select("fold")
        made = sp.entry_thresholds(rows.join(enough, "fold", "left_semi"), f"p_{kind}", F.col("state") == state)
        parts.append(made.withColumn("specialist", F.lit(kind)))
    return parts[0].unionByName(parts[1]).withColumns({"quantile": q._r(F.col("quantile")), "threshold": q._r(F.col("threshold"))})


@q.query("fold_disagreement")
def fold_disagreement(spark, d):
    """Distributions, by fold and state of the test rows, of the companion's probability and of the specialists' distance."""
    rows = bundle(spark, d)["rows"].where("role = 'test'")
    companion = F.when(F.col("state") == "TRENDING", F.col("p_mean")).otherwise(F.col("p_trend"))
    found = rows.withColumns({"companion": companion, "distance": F.abs(F.col("p_trend") - F.col("p_mean"))}).groupBy("fold", "state").agg(
        F.count("*").alias("n"), *[q._r(F.percentile(c, p)).alias(f"{c}_{int(100 * p)}") for c in ("companion", "distance") for p in (0.05, 0.5, 0.95)]
    )
    return found
