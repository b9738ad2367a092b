"""Gates against plain rules written out by hand, over random evidence with nulls and bounds that are met exactly."""

import random
import statistics
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from barweave.operators import gates as g

ORDER = ("net_return", "drawdown", "rtd", "simple_net_return", "buy_hold_drawdown", "simple_rtd", "specialist_rtd", "delayed_rtd", "trades", "positive_profit", "largest_trade", "bootstrap_median", "bootstrap_p05")
FLAGS = ("integrity", "calibration", "replay", "independent", "shuffled_economic", "delayed_supported", "disagreement_supported", "selectivity_supported", "volume_supported", "protection_supported")
VALUES = ["0", "0.02", "-0.02", "0.25", "0.20", "0.35", "0.50", "0.55", "0.525", "1", "-0.05", "0.275", "0.30", "0.04", "-0.01", "-0.06"]


def _subject(rng, i):
    some = lambda p=0.12: None if rng.random() < p else D(rng.choice(VALUES))
    s = {n: some() for n in ORDER}
    s["trades"] = D(rng.choice((29, 30, 31)))
    s["positive_profit"] = rng.choice((None, D("0.2"), D("2")))
    s["flags"] = {n: rng.choice((True, True, True, False, None)) for n in FLAGS}
    s["folds"] = [(k, some(0), some(0.03), some(0.03), D(rng.choice(("0", "5", "10"))), rng.choice((4, 5, 6))) for k in range(1, rng.choice((0, 4, 5, 12, 12, 12)) + 1)]
    s["near"] = [(some(0), some(0)) for _ in range(rng.choice((0, 9, 10, 10, 11)))]
    s["costs"] = {k: (some(0), some(0)) for k in ("one_half", "double") if rng.random() < 0.9}
    s["regimes"] = [(some(0), rng.choice((0, 3))) for _ in range(rng.choice((0, 4)))]
    s["fits"] = [(k, rng.random() < 0.98, rng.choice((10, 10, 10, 49999))) for k in rng.choice(((), range(1, 13), range(1, 13), range(1, 12), [*range(1, 12), 11]))]
    kinds = [(k, w, p) for k in range(1, 13) for w in ("trend", "mean_reversion") for p in (60, 75)]
    s["replays"] = [(*k, rng.random() < 0.99) for k in kinds[: rng.choice((0, 47, 48, 48, 48))]]
    return s


def _plain(s):
    """Statuses by gate and policy, rule by rule."""
    fl, folds, near, net = s["flags"], s["folds"], s["near"], s["net_return"]
    true = lambda x: "MISSING" if x is None else "PASSED" if x else "FAILED"
    need = lambda f, *xs: "MISSING" if None in xs else true(f(*xs))
    n, out = len(folds), {}
    profit = sum(max(f[4], 0) for f in folds)
    half, double = s["costs"].get("one_half", (None, None)), s["costs"].get("double", (None, None))
    worst = min((r for r, k in s["regimes"] if k > 0), default=D(0))
    both = {
        "development.positive_return_folds": true((sum(f[1] > 0 for f in folds) / n if n else 0) >= 0.6),
        "development.baseline_rtd_folds": "MISSING" if any(f[2] is None or f[3] is None for f in folds) else true((sum(f[2] > f[3] for f in folds) / n if n else 0) >= 0.6),
        "development.profit_concentration": true((max(f[4] for f in folds) / profit if profit else 1) <= D("0.5")),
        "development.trade_count": true(sum(f[5] for f in folds) >= 60),
        "cost.one_half_return": need(lambda x: x > 0, half[0]), "cost.one_half_drawdown": need(lambda x: x <= D("0.275"), half[1]),
        "cost.double_return": need(lambda x: x >= D("-0.05"), double[0]), "cost.double_drawdown": need(lambda x: x <= D("0.30"), double[1]),
        "cost.monotonicity": need(lambda a, b, c: a >= b >= c, net, half[0], double[0]),
        "uncertainty.bootstrap_median": need(lambda x: x > 0, s["bootstrap_median"]), "uncertainty.bootstrap_lower_bound": need(lambda x: x > D("-0.02"), s["bootstrap_p05"]),
        "control.shuffled_labels": need(lambda x: not x, fl["shuffled_economic"]), "control.no_volume": true(fl["volume_supported"]), "control.no_protection": true(fl["protection_supported"]),
    }
    median = statistics.median([r for r, _ in near]) if near else D(0)
    stable = lambda v: v > D("0.02") or all(r <= 2 * v for r, _ in near)
    spread = [true(sum(r > 0 for r, _ in near) >= 7), true(median > 0), true(bool(near) and max(d for _, d in near) <= D("0.35"))]
    rtd, dd = s["rtd"], s["drawdown"]
    out["v0.1"] = {
        **both, "development.fold_count": true(n >= 5),
        "final.net_return": need(lambda x: x > 0, net), "final.trade_count": true(s["trades"] >= 30), "final.absolute_drawdown": need(lambda x: x <= D("0.25"), dd),
        "final.relative_drawdown": need(lambda x, y: x <= D("0.8") * y, dd, s["buy_hold_drawdown"]), "final.return_to_drawdown": need(lambda x: x >= D("0.5"), rtd),
        "final.simple_baseline_rtd": need(lambda x, y: x >= D("1.1") * y, rtd, s["simple_rtd"]), "final.specialist_rtd": need(lambda x, y: x >= D("1.05") * y, rtd, s["specialist_rtd"]),
        "final.simple_baseline_net_return": need(lambda x, y: x >= y - D("0.02"), net, s["simple_net_return"]), "final.trade_concentration": need(lambda x: x <= D("0.25"), s["largest_trade"]),
        "final.regime_nonnegative": true(sum(k > 0 and r >= 0 for r, k in s["regimes"]) >= 2), "final.regime_loss": need(lambda p: worst >= D("-0.25") * p, s["positive_profit"]),
        "sensitivity.positive_neighbors": true(len(near) >= 10 and spread[0] == "PASSED"), "sensitivity.median_return": spread[1], "sensitivity.drawdown": spread[2],
        "sensitivity.primary_stability": need(stable, net),
        "control.delayed_features": need(lambda x, y: x <= D("1.05") * y, s["delayed_rtd"], rtd), "control.no_disagreement": true(fl["disagreement_supported"]),
    }
    fits = [k for k, _, _ in s["fits"]]
    q75 = [r for r in s["replays"] if r[2] == 75]
    later = {
        **both, "integrity.verified": true(fl["integrity"]), "calibration.complete": true(fl["calibration"]), "replay.verified": true(fl["replay"]), "independent.verified": true(fl["independent"]),
        "convergence.trend_determinism": true(None if not fits else fits == list(range(1, 13)) and all(e and i < 50000 for _, e, i in s["fits"])), "development.fold_count": true(n == 12),
        "sensitivity.positive_neighbors": true(len(near) == 10 and spread[0] == "PASSED") if near else "MISSING", "sensitivity.median_return": spread[1] if near else "MISSING",
        "sensitivity.drawdown": spread[2] if near else "MISSING", "sensitivity.primary_stability": need(stable, net) if near else "MISSING", "control.delayed_features": true(fl["delayed_supported"]),
    }
    out["v0.2"] = {**later, "control.no_disagreement": true(fl["disagreement_supported"])}
    out["v0.3"] = {**later, "control.no_percentile_selectivity": true(fl["selectivity_supported"]), "selectivity.replay": true(None if len(q75) != 24 else all(r[3] for r in q75))}
    return out


def test_gates_match_plain_rules(spark):
    rng = random.Random(5)
    cases = {f"s{i}": _subject(rng, i) for i in range(150)}
    table = lambda rows, schema: spark.createDataFrame(rows, f"subject string, {schema}")
    v = g.VALUE
    final = table([(k, *[s[n] for n in ORDER]) for k, s in cases.items()], ", ".join(f"{n} {v}" for n in ORDER))
    flags = table([(k, *s["flags"].values()) for k, s in cases.items()], ", ".join(f"{n} boolean" for n in FLAGS))
    folds = table([(k, *f) for k, s in cases.items() for f in s["folds"]], f"fold int, net_return {v}, rtd {v}, baseline_rtd {v}, positive_profit {v}, trades int")
    variants = table([(k, "neighbor", *x) for k, s in cases.items() for x in s["near"]] + [(k, w, *x) for k, s in cases.items() for w, x in s["costs"].items()], f"kind string, net_return {v}, drawdown {v}")
    regimes = table([(k, *x) for k, s in cases.items() for x in s["regimes"]], f"net_return {v}, periods int")
    fits = table([(k, *x) for k, s in cases.items() for x in s["fits"]], "fold int, exact boolean, iterations int")
    replays = table([(k, *x) for k, s in cases.items() for x in s["replays"]], "fold int, specialist string, percentile int, exact boolean")
    measures = g.long(final, *ORDER).unionByName(g.long(flags, *FLAGS)).unionByName(g.fold_measures(final, folds)).unionByName(g.variant_measures(final, variants)).unionByName(g.regime_measures(final, regimes)).unionByName(g.receipt_measures(fits, replays))
    subjects = final.select("subject", F.explode(F.array(*map(F.lit, g.POLICIES))).alias("policy"))
    outcomes = g.evaluate(subjects, measures, g.gate_table(spark)).cache()
    got = {}
    for r in outcomes.collect():
        got.setdefault((r["subject"], r["policy"]), {})[r["gate"]] = r["status"]
    want = {(k, p): st for k, s in cases.items() for p, st in _plain(s).items()}
    assert {k: len(x) for (i, k), x in want.items() if i == "s0"} == {"v0.1": 32, "v0.2": 26, "v0.3": 27}
    wrong = [(k, gate, got[k].get(gate), w, cases[k[0]]) for k, x in want.items() for gate, w in x.items() if got[k].get(gate) != w]
    assert not wrong, wrong[:3]
    seen = {(gate, w) for x in want.values() for gate, w in x.items()}
    assert {gate for gate, w in seen if w == "FAILED"} == {gate for gate, _ in seen} == {gate for gate, w in seen if w == "PASSED"}
    for r in g.verdict(outcomes).collect():
        said = list(want[(r["subject"], r["policy"])].values())
        assert r["verdict"] == ("REJECTED" if "FAILED" in said else "INCONCLUSIVE" if "MISSING" in said else "PASS" if r["policy"] == "v0.1" else "QUALIFIED")
        assert (r["passed"], r["failed"], r["missing"]) == tuple(said.count(x) for x in ("PASSED", "FAILED", "MISSING"))


def test_nothing_given_is_inconclusive(spark):
    """No measure at all: all that is not failed by absence is missing; an unknown policy judges nothing."""
    subjects = spark.createDataFrame([("a", "v0.3"), ("a", "v9")], "subject string, policy string")
    none = spark.createDataFrame([], f"subject string, measure string, value {g.VALUE}")
    r = g.verdict(g.evaluate(subjects, none, g.gate_table(spark))).collect()
    assert [(x["policy"], x["missing"], x["verdict"]) for x in r] == [("v0.3", 27, "INCONCLUSIVE")]


def test_a_measure_given_twice_is_an_error(spark):
    subjects = spark.createDataFrame([("a", "v0.1")], "subject string, policy string")
    twice = spark.createDataFrame([("a", "trades", D(1)), ("a", "trades", D(2)), ("a", "other", D(1)), ("a", "other", D(1))], f"subject string, measure string, value {g.VALUE}")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        g.evaluate(subjects, twice, g.gate_table(spark)).collect()
    assert g.evaluate(subjects, twice.where("measure = 'other'"), g.gate_table(spark)).count() == 32


def test_component_and_control_rules(spark):
    x = spark.createDataFrame([(D("1"), D("0.2"), D("1.1"), D("0.2")), (D("1"), D("0.2"), D("1.09"), D("0.1")), (D("1"), D("0.2"), D("2"), D("0.3")), (None, D("0.2"), D("1"), D("0.2")), (D("1"), None, D("1"), D("0.2"))], f"a {g.VALUE}, b {g.VALUE}, c {g.VALUE}, d {g.VALUE}")
    kept = [tuple(r) for r in x.select(g.component_supported(F.col("a"), F.col("b"), F.col("c"), F.col("d")), g.component_supported(F.col("a"), F.col("b"), F.col("c"), F.col("d"), lower=True)).collect()]
    assert kept == [(False, True), (True, True), (True, True), (False, False), (None, None)]
    y = spark.createDataFrame([(D("0.1"), None, None, None), (D("0"), None, D(0), D(0)), (D("0"), D("0.5"), None, None), (D("0"), D("0.44"), D("0.4"), None), (D("0"), D("0.42"), D("0.4"), D("0.4")), (D("0"), D("0.41"), D("0.4"), D("0.4"))], f"n {g.VALUE}, r {g.VALUE}, s {g.VALUE}, t {g.VALUE}")
    assert [r[0] for r in y.select(g.economic(F.col("n"), F.col("r"), F.col("s"), F.col("t"))).collect()] == [True, False, True, True, True, False]
