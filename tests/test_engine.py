"""Every query with SQL against DuckDB, golden values, and properties of the sequential operators."""

import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from barweave.functions import features
from barweave.functions.rounding import rounded
from barweave.operators import sequential
from barweave.plans import audit, exclusion, gates, guards, late, safe_events, specialist, study  # noqa: F401  register their queries
from barweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(str, frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(SQL[name]).fetchdf())


def test_feature_count():
    assert len(features.registry_sql()) == 74


def _bars(spark, closes):
    return spark.createDataFrame([("X", i, c, c + 3.0, c - 3.0, c, 20.0) for i, c in enumerate(closes)], "symbol string, candle_index long, open double, high double, low double, close double, volume double")


def test_fill_rounds_up_and_pays_fee(spark):
    bars = _bars(spark, [102.0, 105.0, 108.0, 111.0])
    schedule = spark.createDataFrame([("X", 0, "ENTER"), ("X", 1, "HOLD"), ("X", 2, "EXIT"), ("X", 3, "CASH")], "symbol string, candle_index long, action string")
    buy, sell = sequential.simulate(bars, schedule, cash="1000").orderBy("candle_index").collect()
    assert (str(buy["price"])[:6], buy["side"], buy["candle_index"]) == ("105.16", "BUY", 1)
    assert str(sell["price"])[:6] == "110.83" and sell["position"] == 0
    assert buy["cash"] == 1000 - buy["quantity"] * buy["price"] - buy["fee"]


def test_fill_outside_candle_is_none(spark):
    bars = _bars(spark, [102.0, 105.0]).replace(108.0, 105.0, ["high"])
    schedule = spark.createDataFrame([("X", 0, "ENTER"), ("X", 1, "HOLD")], "symbol string, candle_index long, action string")
    assert [r["reason"] for r in sequential.simulate(bars, schedule).collect()] == ["fill_price_outside_candle"]


def test_zscore_needs_a_window(spark):
    assert {r["action"] for r in sequential.zscore_schedule(_bars(spark, [10.0] * 30)).collect()} == {"CASH"}


def test_zscore_tests_the_stop_before_it_trails(spark):
    """A fall makes it enter; while held, a bar that closes high is held though its own trailed stop lies above its low."""
    closes = [100.0, 101.0] * 12 + [90.0, 96.0, 96.5]
    bars = [("X", i, c, c + 0.5, c - 0.5, c, 20.0) for i, c in enumerate(closes)]
    frame = spark.createDataFrame(bars, "symbol string, candle_index long, open double, high double, low double, close double, volume double")
    got = [r["action"] for r in sequential.zscore_schedule(frame, trail_atr=0.0).orderBy("candle_index").collect()]
    # the trailed stop of the bar of 96 is its close, 96, above its low of 95.5; it counts from the next bar, low 96
    assert got[24:] == ["ENTER", "HOLD", "EXIT"]


def _judged(spark, rows, **rule):
    """rows: (index, state, close, low, p_trend, p_mean); one variant."""
    from barweave.operators import arbitration as ar

    made = spark.createDataFrame([("X", 0, i, c, low, 1.0, s, a, m, 0.05, 0.05, True) for i, s, c, low, a, m in rows], "symbol string, segment long, candle_index long, close double, low double, atr double, state string, p_trend double, p_mean double, e_trend double, e_mean double, stretch boolean")
    return ar.arbitrate(ar.verdicts(ar.with_variants(made, {"v": rule}))).orderBy("candle_index").collect()


def test_arbitration_enters_trails_and_cools_down(spark):
    up = [(i, "TRENDING", 100.0 + i, 99.5 + i, 0.7, 0.6) for i in range(5)]
    hit = [(5, "TRENDING", 101.0, 100.5, 0.7, 0.6)]  # peak 104, so the stop is 101
    after = [(i, "TRENDING", 101.0, 100.9, 0.7, 0.6) for i in range(6, 10)]
    got = [(r["action"], r["reason"]) for r in _judged(spark, up + hit + after)]
    assert got == [("ENTER", "enter")] + [("HOLD", "hold")] * 4 + [("EXIT", "stop")] + [("CASH", "cooldown")] * 2 + [("ENTER", "enter"), ("EXIT", "boundary")]


def test_arbitration_vetoes_and_gaps(spark):
    rows = [(0, "TRENDING", 100.0, 99.9, 0.5, 0.2), (1, "UNSTABLE", 100.0, 99.9, 0.9, 0.9), (2, "INDETERMINATE", 100.0, 99.9, 0.9, 0.9), (3, "RANGING", 100.0, 99.9, 0.6, 0.7), (5, "RANGING", 100.0, 99.9, 0.6, 0.7)]
    assert [r["reason"] for r in _judged(spark, rows)] == ["probability,companion,disagreement", "unstable", "indeterminate", "boundary", "boundary"]


def test_arbitration_tolerates_one_indeterminate_bar(spark):
    states = ["TRENDING", "INDETERMINATE", "TRENDING", "INDETERMINATE", "INDETERMINATE", "TRENDING"]
    got = [(r["action"], r["reason"]) for r in _judged(spark, [(i, s, 100.0, 99.9, 0.7, 0.6) for i, s in enumerate(states)])]
    assert got[:5] == [("ENTER", "enter"), ("HOLD", "hold"), ("HOLD", "hold"), ("HOLD", "hold"), ("EXIT", "indeterminate")]


def test_bootstrap_matches_brute_force(spark):
    import numpy as np

    from barweave.operators.bootstrap import block_bootstrap

    rng = np.random.default_rng(3)
    c, base = rng.normal(0.001, 0.02, 50), rng.normal(0, 0.02, 50)
    frame = spark.createDataFrame([("X", i, float(x), float(y)) for i, (x, y) in enumerate(zip(c, base))], "symbol string, candle_index long, candidate double, baseline double")
    got = block_bootstrap(frame, replicates=40, block=8, seed=5).first()

    def told(r):
        wealth, peak, worst = 1.0, 1.0, 0.0
        for x in r:
            wealth *= 1 + x
            peak = max(peak, wealth)
            worst = max(worst, 1 - wealth / peak)
        return np.array([wealth - 1, worst, (wealth - 1) / worst if worst else 0.0])

    diffs = []
    for row in np.random.Generator(np.random.PCG64(5)).integers(0, 43, size=(40, 7)):
        at = [s + k for s in row for k in range(8)][:50]
        diffs.append(told(c[at]) - told(base[at]))
    for k, name in enumerate(("net_return", "drawdown", "return_to_drawdown")):
        expected = np.percentile([d[k] for d in diffs], (5, 50, 95))
        assert [got[f"{name}_{p}"] for p in ("p05", "median", "p95")] == pytest.approx(list(expected), rel=1e-9)


def test_return_sums_near_zero_have_the_sign_of_the_sql(spark):
    """Few prices, so that closes are often the same 6, 12 or 24 bars apart: the sum of returns between is only rounding."""
    rng = random.Random(6)
    prices = [27.17, 64.74, 47.2, 53.88, 18.01, 9.9]
    made = []
    for symbol in "AB":
        for i in range(600):
            c = rng.choice(prices)
            made.append((symbol, i // 300, datetime(2024, 1, 1) + timedelta(hours=i), c, c + 1, c - 1, c, 20.0, i, i % 300))
    names = ["symbol", "segment", "open_time", "open", "high", "low", "close", "volume", "candle_index", "local_index"]
    seg = pd.DataFrame(made, columns=names)
    asked = ["trend_consistency_6", "trend_consistency_12", "trend_consistency_24"]
    got = features.base(spark.createDataFrame(seg)).select("symbol", "candle_index", *[features.registry()[n].alias(n) for n in asked]).toPandas()
    con = duckdb.connect()
    con.register("seg_rows", seg)
    told = features.registry_sql()
    want = con.execute(f"WITH seg AS (SELECT * FROM seg_rows), {features.base_sql()} SELECT symbol, candle_index, {', '.join(f'{told[n]} AS {n}' for n in asked)} FROM base").fetchdf()
    assert rows(got.round(8)) == rows(want.round(8))


def test_feature_matrix_of_repeated_closes_matches_sql(spark):
    """On sf0.1 a close comes again six bars later."""
    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    name = "feature_matrix_complete"
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(SQL[name]).fetchdf())


def test_feature_matrix_of_zero_closes_and_halves_matches_sql(spark, tmp_path):
    """Closes of 0, after which no return is taken, and fractions of power-of-two ranges, whose ninth place is a half."""
    rng, made = random.Random(4), []
    for symbol in ("click", "error", "view"):
        for i in range(150):
            low = 0.0 if i < 20 else 0.5
            for value in [low, 128.0 + low, *[round(rng.uniform(1, 128), 2) for _ in range(rng.randrange(1, 6))], 0.0 if i % 7 == 3 and i < 20 else round(rng.uniform(1, 128), 2)]:
                made.append((len(made), datetime(2024, 1, 1) + timedelta(hours=i, seconds=len(made) % 3000 / 1000 + len(made) / 1e6), symbol, value))
    pd.DataFrame(made, columns=["event_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet", index=False)
    con, name = duckdb.connect(), "feature_matrix_complete"
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(SQL[name]).fetchdf()
    assert len(want) > 200
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(want)


def test_rounding_equals_the_sql_at_halves(spark):
    values = [k / 2**m for m in (8, 9, 10, 12) for k in range(-2 * 2**9, 2 * 2**9, 7)] + [k / 256 * 1.01 for k in range(200)] + [5.02 / 256, 159.7 / 256, 1e-9, -5e-9, 0.0]
    frame = pd.DataFrame({"x": values})
    for places in (8, 6, 4):
        got = spark.createDataFrame(frame).select("x", rounded("x", places).alias("y")).toPandas()
        con = duckdb.connect()
        con.register("t", frame)
        want = con.execute(f"SELECT x, round(x, {places}) AS y FROM t").fetchdf()
        assert rows(got) == rows(want)  # the sign of zero too
