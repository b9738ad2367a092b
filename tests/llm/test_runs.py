"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from barweave.llm import runs


def brute_runs(w, shortest=24, exponent=3):
    """Every maximal stretch of each period, the smallest first."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, t - s, q) for (s, t), q in found.items())


def pieces(rng, letters):
    """Random words with stretches repeated, copied and broken."""
    w = []
    while len(w) < rng.randrange(20, 260):
        kind = rng.random()
        if kind < 0.4 or not w:
            w += [rng.randrange(letters) for _ in range(rng.randrange(1, 15))]
        elif kind < 0.75:
            base = [rng.randrange(letters) for _ in range(rng.randrange(1, 14))]
            whole = base * rng.randrange(2, 8)
            w += whole[: len(whole) - rng.randrange(len(base))]
        else:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randrange(1, 90)]
        if rng.random() < 0.2:
            w[rng.randrange(len(w))] = rng.randrange(letters)
    return w


@pytest.mark.parametrize("shortest,exponent", [(24, 3), (6, 3), (9, 4), (40, 5)])
def test_runs_match_brute_force(shortest, exponent):
    rng, some = random.Random(shortest), 0
    for turn in range(1500):
        w = pieces(rng, rng.choice([1, 2, 3, 5, 50]))
        want = brute_runs(w, shortest, exponent)
        assert runs.runs_of(w, shortest, exponent) == want, w
        words = [f"w{x}".encode() for x in w]
        assert runs._runs_of_many([words, [], words], shortest, exponent) == [want, [], want], w
        some += len(want)
    assert some > 300


def test_factors_are_longest_earlier_occurrences():
    rng = random.Random(5)
    for _ in range(300):
        w = pieces(rng, rng.choice([1, 2, 4]))
        at = 0
        for low, high, origin in runs.factors(w):
            assert low == at
            at = high
            longest, first = 0, -1
            for p in range(low):
                k = 0
                while low + k < len(w) and w[p + k] == w[low + k]:
                    k += 1
                if k > longest:
                    longest, first = k, p
            assert (high - low, origin) == ((longest, first) if longest else (1, -1))
        assert at == len(w)


def test_long_texts_take_linear_time():
    w = [0] * 60_000
    assert runs.runs_of(w) == [(0, 60_000, 1)]
    w = list(range(7_000)) * 4 + [9]
    assert runs.runs_of(w) == [(0, 28_000, 7_000)]


def expected(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *tail, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"é{x}" for x in pieces(rng, 6)) if i % 3 else "\n\t ".join(str(x) for x in pieces(rng, 2))) for i in range(400)]
    rows += [(7, rows[7][1]), (None, "a " * 40), (None, None), (900, None), (901, ""), (902, " \n "), (903, " x " * 30), (-5, "b c " * 30), (904, "word")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, words string")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 50


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.periodic_runs(runs.periodic_tails(empty)).count() == 0
