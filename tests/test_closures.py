"""Closure manifests and row exclusion against a plain walk over the same pages."""

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barweave.operators import closures as cl

H, MS, START = timedelta(hours=1), timedelta(milliseconds=1), datetime(2024, 1, 1)
WIDTH = "INTERVAL '1' HOUR"
COLUMNS = "schema_version string, provider string, symbol string, timeframe string, start_time timestamp_ntz, end_time timestamp_ntz, place int, closure_id string, gap_start timestamp_ntz, resumed_open timestamp_ntz, unavailable bigint, missing_start timestamp_ntz, missing bigint, reason_code string, governance_reference string, partial_open timestamp_ntz, actual_close timestamp_ntz, expected_close timestamp_ntz, row_sha256 string, exclusion_reason string"


def _ms(t):
    return int((t - datetime(1970, 1, 1)) / MS)


def _row(t, close, price="1.5"):
    return [_ms(t), price, price, price, price, "3", _ms(close), "é\"/", 7]


def _text(row):
    return json.dumps(row, ensure_ascii=False, separators=(",", ":"))


def _series(rng, symbol, n=200):
    """Hourly rows with closures of one to four slots, each begun by a partial row, and their declarations."""
    rows, declared, t, end = [], [], START, START + n * H
    while t < end:
        if rng.random() < 0.05 and t > START and t + 6 * H < end and (not declared or t > declared[-1]["resumed_open"]):
            row, length = _row(t, t + timedelta(minutes=20)), rng.randint(1, 4)
            rows.append(row)
            declared.append({"schema_version": "1", "provider": "p", "symbol": symbol, "timeframe": "1h", "start_time": START, "end_time": end, "place": len(declared), "closure_id": f"{symbol}-{len(declared)}", "gap_start": t, "resumed_open": t + length * H, "unavailable": length, "missing_start": t + H, "missing": length - 1, "reason_code": "outage", "governance_reference": "r", "partial_open": t, "actual_close": t + timedelta(minutes=20), "expected_close": t + H - MS, "row_sha256": hashlib.sha256(_text(row).encode()).hexdigest(), "exclusion_reason": "partial"})
            t += length * H
        else:
            rows.append(_row(t, t + H - MS))
            t += H
    return rows, declared


def _plain(rows, declared, now):
    """(place or None, open, status, reason, closure) by one walk."""
    out, seen, before = [], set(), None
    role = {}
    for d in declared:
        k = d["gap_start"]
        while k <= d["resumed_open"]:
            role[k] = ("partial" if k == d["gap_start"] else "resumed" if k == d["resumed_open"] else "absent", d)
            k += H
    for i, row in enumerate(rows):
        if any(isinstance(x, (bool, float)) or x is None for x in row) or len(row) < 7:
            out.append((i, "fault", "malformed_row"))
            continue
        t, close = (datetime(1970, 1, 1) + timedelta(milliseconds=row[k]) for k in (0, 6))
        part, d = role.get(t, ("", None))
        why = None
        if declared and not declared[0]["start_time"] <= t < declared[0]["end_time"]:
            why = "outside_window"
        elif before is not None and t <= before:
            why = "not_ascending"
        elif part == "absent":
            why = "row_in_closure"
        elif part == "partial":
            sha = hashlib.sha256(_text(row).encode()).hexdigest()
            why = "actual_close" if close != d["actual_close"] else "row_hash" if sha != d["row_sha256"] else "not_closed" if close >= now else None
        elif close != t + H - MS:
            why = "undeclared_partial"
        out.append((i, "fault" if why else "excluded" if part == "partial" else "open" if close >= now else "keep", why))
        seen.add(t)
        before = t
    for t, (part, d) in role.items():
        if t not in seen and part != "absent":
            out.append((None, "fault", f"missing_{part}"))
    return out


def _damage(rng, rows, declared):
    starts = {d["gap_start"]: d for d in declared}
    for _ in range(rng.randint(0, 5)):
        near = [k for k, r in enumerate(rows) if any(r[0] in (_ms(d["gap_start"]), _ms(d["resumed_open"])) for d in declared)]
        i, kind = rng.choice(near + [rng.randrange(1, len(rows))]), rng.choice("drop twice swap cut price early late".split())
        t = datetime(1970, 1, 1) + timedelta(milliseconds=rows[i][0])
        if kind == "drop":
            del rows[i]
        elif kind == "twice":
            rows.insert(i, list(rows[i]))
        elif kind == "swap":
            rows[i - 1], rows[i] = rows[i], rows[i - 1]
        elif kind == "cut":
            rows[i][6] -= 5
        elif kind == "price":
            rows[i][2] = "9.25"
        elif kind == "early":
            rows.insert(0, _row(START - H, START - MS))
        elif kind == "late" and t in starts and starts[t]["missing"]:
            rows.insert(i + 1, _row(t + H, t + 2 * H - MS))


def _pages(rows, symbol, size, rng):
    spaced = lambda part: json.dumps(part, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1)))
    return [(symbol, k // size + 1, spaced(rows[k : k + size])) for k in range(0, len(rows), size)]


def test_rows_match_a_plain_walk(spark, tmp_path):
    rng = random.Random(11)
    pages, declared, want, now = [], [], {}, START + 190 * H
    for i in range(60):
        symbol = f"S{i}"
        rows, decl = _series(rng, symbol)
        if not decl:
            continue
        if i % 3:
            _damage(rng, rows, decl)
        if i % 7 == 1:
            decl.pop(rng.randrange(len(decl)))
            if not decl:
                continue
            decl = [{**d, "place": k} for k, d in enumerate(decl)]
        want[symbol] = sorted(_plain(rows, decl, now), key=str)
        pages += _pages(rows, symbol, rng.choice((7, 50)), rng)
        declared += decl
    closures = spark.createDataFrame([tuple(d[c.split()[0]] for c in COLUMNS.split(", ")) for d in declared], COLUMNS)
    path = str(tmp_path / "manifests")
    cl.write_manifests(closures, path)
    read = cl.read_manifests(spark, path)
    key = ["symbol", "place"]
    assert list(map(tuple, read.select(closures.columns).orderBy(key).collect())) == list(map(tuple, closures.orderBy(key).collect()))
    assert cl.manifest_faults(read, WIDTH).count() == 0
    judged = cl.judge(spark.createDataFrame(pages, "symbol string, page int, body string").repartition(5), read, str(now), WIDTH).cache()
    got = {}
    for r in judged.collect():
        got.setdefault(r["symbol"], []).append((r["place"], r["status"], r["reason"]))
    got = {k: sorted(v, key=str) for k, v in got.items()}
    assert set(got) == set(want)
    assert not [(k, set(got[k]) ^ set(want[k])) for k in want if got[k] != want[k]]
    reasons = {r for v in want.values() for _, _, r in v}
    assert reasons >= {None, "outside_window", "not_ascending", "row_in_closure", "actual_close", "row_hash", "undeclared_partial", "missing_partial", "missing_resumed"}
    clean = [k for k, v in want.items() if all(s != "fault" for _, s, _ in v)]
    assert cl.kept(judged.where(F.col("symbol").isin(clean))).count() == sum(s == "keep" for k in clean for _, s, _ in want[k])
    with pytest.raises(Exception, match="row fault"):
        cl.kept(judged).collect()


def _declared(spark, *changes, **all_of):
    _, decl = _series(random.Random(1), "X", 120)
    rows = [{**d, **(changes[i] if i < len(changes) else {})} for i, d in enumerate(decl[:3])]
    return spark.createDataFrame([tuple({**d, **all_of}[c.split()[0]] for c in COLUMNS.split(", ")) for d in rows], COLUMNS)


def test_manifest_rules(spark):
    _, decl = _series(random.Random(1), "X", 120)
    a, b = decl[0], decl[1]
    reasons = lambda frame: sorted({r["reason"] for r in cl.manifest_faults(frame, WIDTH).collect()})
    assert reasons(_declared(spark)) == []
    assert reasons(_declared(spark, {"closure_id": b["closure_id"]})) == ["repeated_id"]
    assert reasons(_declared(spark, {"row_sha256": b["row_sha256"]})) == ["repeated_row_hash"]
    assert reasons(_declared(spark, {"row_sha256": "AB" * 32})) == ["hash_is_not_hex"]
    assert reasons(_declared(spark, {"reason_code": " "})) == ["blank_text"]
    assert reasons(_declared(spark, {"unavailable": a["unavailable"] + 1})) == ["missing_count", "unavailable_count"]
    assert reasons(_declared(spark, {"expected_close": a["expected_close"] + MS})) == ["expected_close"]
    assert reasons(_declared(spark, {"actual_close": a["expected_close"]})) == ["partial_bounds"]
    assert reasons(_declared(spark, {"place": 9})) == ["out_of_order", "touches_the_one_before"]
    assert "touches_the_one_before" in reasons(_declared(spark, {"resumed_open": b["gap_start"]}))
    assert "not_aligned" in reasons(_declared(spark, {"resumed_open": a["resumed_open"] + timedelta(minutes=1)}))
    assert reasons(_declared(spark, start_time=a["resumed_open"])) == ["outside_window"]
    assert "partial_not_at_start" in reasons(_declared(spark, {"partial_open": a["gap_start"] - H}))


def test_manifests_that_are_not_canonical_are_errors(spark, tmp_path):
    path = str(tmp_path / "good")
    cl.write_manifests(_declared(spark), path)
    text = next((tmp_path / "good").glob("symbol=X/part-*")).read_text()
    assert cl.read_manifests(spark, path).count() == 3
    for i, bad in enumerate((text.replace(",", ", ", 1), text.replace('"provider"', '"more":1,"provider"', 1), text.rstrip("\n"), text.replace("2024-01-01T00:00:00Z", "2024-01-01T00:00:00.000Z", 1), "[]\n", text + "\n")):
        folder = tmp_path / f"bad{i}"
        folder.mkdir()
        (folder / "m.json").write_text(bad)
        with pytest.raises(Exception, match="canonical"):
            cl.read_manifests(spark, str(folder)).collect()


def test_malformed_rows_and_pages(spark):
    none = spark.createDataFrame([], COLUMNS)
    good = _row(START, START + H - MS)
    bodies = [json.dumps([good, [*good[:5], 1.5, good[6]], good[:6], [None, *good[1:]], ["1e3", *good[1:]]]), "[]", "{", None]
    pages = spark.createDataFrame([("A", i + 1, b) for i, b in enumerate(bodies)] + [("B", 2, json.dumps([good]))], "symbol string, page int, body string")
    judged = [(r["symbol"], r["row_index"], r["status"], r["reason"]) for r in cl.judge(pages, none, "2030-01-01", WIDTH).orderBy("symbol", "page", "row_index").collect()]
    assert judged == [("A", 0, "keep", None), *[("A", i, "fault", "malformed_row") for i in (1, 2, 3, 4)], ("B", 0, "keep", None)]
    assert [tuple(r) for r in cl.page_faults(pages, none).collect()] == [("B", 2, "missing_page")]
    assert sorted(r["reason"] for r in cl.page_faults(pages.where("symbol = 'A'"), _declared(spark)).collect()) == ["no_pages"]
    assert cl.judge(pages.limit(0), none, "2030-01-01", WIDTH).count() == 0
