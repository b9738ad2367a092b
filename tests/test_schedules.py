"""Boundary-safe schedules against a plain walk, over random decisions, gaps, boundaries and blocks."""

import random

import pytest

from barweave.operators.schedules import boundary_safe_events


def walk(rows, boundaries, latency):
    """Event lists by the rules one at a time: a row of (index, up, down) after another, rewriting what came before."""
    events, long, seen = [], False, None

    def leave(boundary):
        nonlocal events
        safe = boundary - 2 - latency
        events = [e for e in events if e[0] <= safe]
        if safe >= 0 and events and events[-1][1] == "ENTER":
            events = events[:-1] if events[-1][0] == safe else [*events, (safe, "EXIT")]

    for i, up, down in rows:
        passed = [] if seen is None else [b for b in boundaries if seen < b <= i]
        for b in passed:
            leave(b)
        if passed:
            long = False
        elif seen is not None and i > seen + 1:
            if long:
                events = events[:-1] if events[-1] == (seen, "ENTER") else [*events, (seen, "EXIT")]
            long = False
        if up and not long:
            events.append((i, "ENTER"))
        elif down and long:
            events.append((i, "EXIT"))
        long = up or (long and not down)
        seen = i
    if long:
        events.append((seen, "EXIT"))
    for b in boundaries:
        if seen is not None and seen < b <= seen + 1 + latency:
            leave(b)
    return sorted(dict(events).items())


def decisions(spark, series):
    flat = []
    for name, (rows, boundaries) in series.items():
        for i, up, down in rows:
            flat.append((name, i, sum(b <= i for b in boundaries), min((b for b in boundaries if b > i), default=None), up, down))
    return spark.createDataFrame(flat, "symbol string, candle_index long, segment long, boundary long, up boolean, down boolean")


@pytest.mark.parametrize(("latency", "block"), [(0, 4096), (1, 5), (3, 1), (0, 3)])
def test_events_equal_walk(spark, latency, block):
    rng = random.Random(latency * 100 + block)
    series = {}
    for k in range(150):
        spots = [i for i in range(rng.randrange(1, 45)) if rng.random() > 0.12]
        kinds = rng.choices([(True, False), (False, True), (False, False)], [3, 2, 4], k=len(spots))
        boundaries = sorted(rng.sample(range(1, 50), rng.randrange(0, 5)))
        series[f"s{k}"] = ([(i, *kind) for i, kind in zip(spots, kinds)], boundaries)
    got = {name: [] for name in series}
    for r in boundary_safe_events(decisions(spark, series).repartition(4), ["symbol"], latency, block).collect():
        got[r["symbol"]].append((r["candle_index"], r["action"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: walk(*v, latency) for k, v in series.items()}
    assert sum(map(len, got.values())) > 200


def test_boundary_gap_and_last_bar(spark):
    series = {
        "left before a boundary": ([(0, True, False), *((i, False, False) for i in range(1, 9))], [6]),
        "entered at the last safe bar": ([(3, False, False), (4, True, False), (5, False, False), (6, False, False)], [6]),
        "left before a gap": ([(0, True, False), (1, False, False), (5, False, False)], []),
        "entered before a gap": ([(0, True, False), (5, False, False)], []),
        "held at the end": ([(0, True, False), (1, False, False)], []),
        "boundary just after the end": ([(0, True, False), (1, False, False), (2, False, False)], [3]),
    }
    got = {}
    for r in boundary_safe_events(decisions(spark, series), ["symbol"]).collect():
        got.setdefault(r["symbol"], []).append((r["candle_index"], r["action"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        "left before a boundary": [(0, "ENTER"), (4, "EXIT")],
        "left before a gap": [(0, "ENTER"), (1, "EXIT")],
        "held at the end": [(0, "ENTER"), (1, "EXIT")],
        "boundary just after the end": [(0, "ENTER"), (1, "EXIT")],
    }
    with pytest.raises(ValueError, match="latency"):
        boundary_safe_events(decisions(spark, series), ["symbol"], -1)
    none = decisions(spark, series).where("false")
    assert boundary_safe_events(none, ["symbol"]).count() == 0
