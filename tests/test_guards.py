"""Canonical candle files byte for byte, series guards rule by rule, and sets of ids with planted faults."""

import json
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest

from barweave.operators import guards
from barweave.sources import canonical

T = datetime(2024, 1, 1)
COLUMNS = "symbol string, base_asset string, quote_asset string, timeframe string, open_time timestamp_ntz, close_time timestamp_ntz, open string, high string, low string, close string, volume string, completed boolean, source_provider string, extra int"


def _candle(i, symbol="Bé", **changes):
    t = T + timedelta(hours=i)
    row = {"symbol": symbol, "base_asset": 'B"\\', "quote_asset": "/U", "timeframe": "1h", "open_time": t, "close_time": t + timedelta(hours=1) - timedelta(milliseconds=1), "open": "1.50", "high": "2.0", "low": "1", "close": "0.00000001", "volume": "0", "completed": True, "source_provider": "p", "extra": 1}
    return {**row, **changes}


def _stamp(t):
    return t.isoformat(timespec="milliseconds") + "Z"


def _plain_line(c):
    x = {k: _stamp(v) if k.endswith("_time") else v for k, v in c.items() if k != "extra"}
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _bytes(folder):
    return b"".join(f.read_bytes() for f in sorted(folder.glob("part-*")))


def test_files_are_the_same_bytes_again(spark, tmp_path):
    made = [_candle(i, s) for s in ("Bé", "A") for i in range(50)]
    made[3]["open"] = "12345678901234567890.123456789012345678"
    frame = spark.createDataFrame([tuple(c.values()) for c in reversed(made)], COLUMNS)
    canonical.write_candles(frame, str(tmp_path / "a"))
    want = "".join(_plain_line(c) + "\n" for c in sorted(made, key=lambda c: (c["symbol"], c["open_time"])))
    assert _bytes(tmp_path / "a") == want.encode()
    read = canonical.read_candles(spark, str(tmp_path / "a"), "p")
    assert read.columns == canonical.FIELDS and read.count() == 100
    canonical.write_candles(read, str(tmp_path / "b"))
    assert _bytes(tmp_path / "b") == want.encode()


def test_decimals_are_written_plainly(spark):
    frame = spark.createDataFrame([tuple({**_candle(0), "close": D("0E-8")}.values())], COLUMNS.replace("close string", "close decimal(20,8)"))
    assert json.loads(canonical.encode(frame).collect()[0]["line"])["close"] == "0.00000000"


@pytest.mark.parametrize("change", [{"completed": False}, {"completed": None}, {"close": None}, {"open_time": None}, {"volume": "1E3"}, {"high": "NaN"}, {"low": "+1"}])
def test_what_is_not_written(spark, change):
    frame = spark.createDataFrame([tuple(_candle(0, **change).values())], COLUMNS)
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        canonical.encode(frame).collect()


def test_faulty_lines_are_told(spark, tmp_path):
    good = _plain_line(_candle(0))
    bad = {
        good: None, "": "not_json", "{": "not_json", "[1]": "not_json", good.replace(",", ", ", 1): "not_canonical", good[:-1] + ',"more":1}': "not_canonical",
        good.replace('"completed":true,', ""): "not_canonical", good.replace('"1.50"', "1.50"): "not_canonical", good.replace('"1.50"', '"1.5E0"'): "not_canonical", good.replace("00:00:00.000Z", "00:00:00Z", 1): "not_canonical",
        good.replace("2024-01-01T00", "2024-13-01T00", 1): "not_canonical", good.replace("é", "\\u00e9"): "not_canonical", good.replace("true", "false"): "not_completed", good.replace('"p"', '"q"'): "other_provider", good.replace('"/U"', "null"): "not_canonical",
    }
    (tmp_path / "x.jsonl").write_text("".join(k + "\n" for k in bad))
    assert {r["line"]: r["fault"] for r in canonical.scan(spark, str(tmp_path), "p").collect()} == bad
    with pytest.raises(Exception, match="line fault: .*x.jsonl"):
        canonical.read_candles(spark, str(tmp_path), "p").collect()


def test_series_guard_rule_by_rule(spark):
    base = {"symbol": "X", "timeframe": "1h", "open_time": None, "open": 2.0, "high": 3.0, "low": 1.0, "close": 2.0, "volume": 5.0, "completed": True, "more": None}
    cases = [({}, None), ({"completed": False}, "not_completed"), ({"completed": None}, "not_completed"), ({"timeframe": "4h"}, "other_timeframe"), ({"timeframe": None}, "other_timeframe"), ({"close": float("nan")}, "not_finite"), ({"volume": None}, "not_finite"), ({"high": float("inf")}, "not_finite"), ({"close": 0.0}, "not_positive"), ({"volume": 0.0}, "not_positive"), ({"open": 3.5}, "inconsistent"), ({"low": 2.5}, "inconsistent"), ({"open": -1.0, "low": -2.0}, None), ({"completed": False, "volume": 0.0}, "not_completed")]
    rows = [{**base, "open_time": T + timedelta(hours=i), "more": i, **ch} for i, (ch, _) in enumerate(cases)]
    schema = "symbol string, timeframe string, open_time timestamp_ntz, open double, high double, low double, close double, volume double, completed boolean, more int"
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert [r["fault"] for r in guards.candle_faults(frame, "1h").orderBy("more").collect()] == [w for _, w in cases]
    sound = frame.where("more IN (0, 12)")
    assert guards.guarded(sound, "1h").count() == 2 and guards.guarded(sound.limit(0), "1h").count() == 0
    assert sorted(str(r["fault"]) for r in guards.candle_faults(sound.unionByName(sound.limit(1)), "1h").collect()) == ["None", "None", "not_chronological"]
    with pytest.raises(Exception, match="candle fault"):
        guards.guarded(frame, "1h").count()


def test_id_sets_and_known_joins(spark):
    declared = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), (None, 5)], "id string, v int")
    used = spark.createDataFrame([("a",)] * 1000 + [("b",), ("z",), (None,)], "id string")
    got = {r["id"]: (r["declarations"], r["uses"], r["status"]) for r in guards.id_sets(declared, used, "id").collect()}
    assert got == {"a": (1, 1000, "ok"), "b": (2, 1, "repeated"), "c": (1, 0, "unused"), "z": (0, 1, "unknown"), None: (1, 1, "ok")}
    assert guards.id_sets(declared.limit(0), used.limit(0), "id").count() == 0
    assert guards.join_known(used.where("id IN ('a', 'b')"), declared, "id").count() == 1002
    for bad in ("id = 'z'", "id IS NULL"):
        with pytest.raises(Exception, match="unknown id"):
            guards.join_known(used.where(bad), declared, "id").collect()
