"""The prefix-tree join against all pairs."""

import itertools
import random

import numpy as np
import pytest

from barweave.llm import prefix_tree
from barweave.llm.common import join_spread


def gram_sets(texts, n=3):
    out = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def brute(texts, percent=90):
    sets, root = gram_sets(texts), {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in texts}


def joined(spark, texts, **options):
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, node int, k string").repartition(5)
    return {r["doc_id"]: (r["n_grams"], r["component_id"]) for r in prefix_tree.similar_sets(rows, **options).collect()}


def variants(rng, base, changes):
    w = list(base)
    for _ in range(changes):
        k = rng.randrange(len(w))
        kind = rng.random()
        w[k : k + 1] = [] if kind < 0.2 else [f"n{rng.randrange(10**6)}"] if kind < 0.8 else [w[k], f"n{rng.randrange(99)}"]
    return " ".join(w)


def test_pairs_near_the_limit(spark):
    """Groups of two to five with zero to five changed words, on both sides of 0.9."""
    rng, texts = random.Random(1), {}
    for _ in range(150):
        base = [f"W{rng.randrange(60)}" for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 6)):
            texts[rng.randrange(10**9)] = variants(rng, base, rng.randrange(0, 4))
    texts |= {1: None, 2: "", 3: " \n\t ", 4: "One", 5: "oNE ", 6: "one two", 7: "ONE\ttwo", 8: "one two three", 9: "one two three four", 10: "É é", 11: "é é"}
    want = brute(texts)
    assert 100 < sum(c == i for i, (_, c) in want.items()) < len(texts) - 80
    assert joined(spark, texts) == want


def test_crowded_branches(spark):
    """Many variants of one text, copies of one, and a passage that all of them share."""
    rng = random.Random(2)
    base, passage = [f"t{i}" for i in range(150)], " ".join(f"p{i}" for i in range(30))
    texts = {i: variants(rng, base, rng.randrange(0, 4)) for i in range(250)}
    texts |= {i: "same words in all of these texts" for i in range(300, 340)}
    texts |= {i: passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 5))) for i in range(400, 480)}
    assert joined(spark, texts) == brute(texts)


def test_long_sets_differ_in_no_more_classes_than_values():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = rng.integers(0, 1 << 62, rng.integers(1001, 3000))
        a, b = np.unique(base[: rng.integers(900, len(base) + 1)]), np.unique(np.append(base[rng.integers(0, 100) :], rng.integers(0, 1 << 62, 50)))
        differ = prefix_tree.apart(prefix_tree.wide_parities(a), prefix_tree.wide_parities(b))
        assert differ <= len(np.setxor1d(a, b))
    other = rng.integers(0, 1 << 62, 2000)
    assert prefix_tree.apart(prefix_tree.wide_parities(base), prefix_tree.wide_parities(other)) > 600


def test_long_texts(spark):
    """Groups of long texts on both sides of 0.9 that share many n-grams with all others."""
    rng, texts = random.Random(8), {}
    for i in range(12):
        base = [f"w{rng.randrange(14)}" for _ in range(rng.randrange(1500, 4000))]
        for k in range(4):
            texts[100 * i + k] = variants(rng, base, k * len(base) // 90)
    want = brute(texts)
    assert 12 < len(set(c for _, c in want.values())) < len(texts) - 5
    assert joined(spark, texts) == want


def test_rows_that_repeat_ids_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "x y z"), (3, "x y z"), (None, "a b c d"), (None, "only null"), (None, None), (9, None)]
    got = prefix_tree.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(5, 2, 5), (5, 1, 3), (3, 1, 3), (None, 2, 5), (None, 1, None), (None, 0, None), (9, 0, 9)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert prefix_tree.similar_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_tree_walk_finds_what_pairs_say(percent):
    rng = np.random.default_rng(percent)
    for _ in range(60):
        base = np.unique(rng.integers(0, 300, 80))
        sets = {tuple(np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, len(base) + 1)], rng.integers(0, 300, rng.integers(0, 12))]))) for _ in range(40)}
        own, *others = [np.array(s, np.int64) for s in sets]
        want = [100 * len(np.intersect1d(own, o)) >= percent * len(np.union1d(own, o)) for o in others]
        assert prefix_tree.linked(own, others, percent) == want
    assert prefix_tree.linked(own, [], percent) == []


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_similar_sets_share_a_branch(percent):
    """A set and one that has as many more or less as may be, of every size."""
    for k in range(1, 400):
        whole = np.arange(1, 2 * k + 3)
        least = max(1, -(-percent * k // 100))
        for few in (k, k - 1, least, least + 1):
            if 100 * few >= percent * k and 0 < few <= k:
                a, b = prefix_tree.branches(whole[:k], percent), prefix_tree.branches(whole[k - few : k], percent)
                assert np.intersect1d(a, b).size, (k, few)


@pytest.mark.parametrize("percent", [80, 85, 90, 97])
def test_similar_sets_of_rare_and_common_values_share_a_branch(percent):
    """Values of all frequency classes; what is dropped and added is near the limit, on both sides of it."""
    rng, similar = np.random.default_rng(percent), 0
    for _ in range(1500):
        k = int(np.exp(rng.uniform(0, 7)))
        values = rng.integers(-(1 << 63), (1 << 63) - 1, 2 * k + 2)
        a, most = np.sort(values[:k].view(np.uint64)).view(np.int64), k * (100 - percent) // 90 + 1
        b = np.append(rng.permutation(a)[rng.integers(0, most + 1) :], values[k : k + rng.integers(0, most + 1)])
        b = np.sort(b.view(np.uint64)).view(np.int64)
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
            similar += 1
            assert np.intersect1d(prefix_tree.branches(a, percent), prefix_tree.branches(b, percent)).size, (len(a), len(b), common)
    assert similar > 300


def test_values_shared_by_chance_make_no_branch_common():
    """Sets from few values, as in a large corpus: each value is in many, and the first of a set are in others too."""
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 62, 20000))
    sets = [np.sort(rng.choice(values, rng.integers(40, 400), replace=False)) for _ in range(1500)]
    keys, counts = np.unique(np.concatenate([np.unique(prefix_tree.branches(s, 90)) for s in sets]), return_counts=True)
    assert len(keys) > 20 * len(sets)
    assert counts[counts > 1].sum() < 0.01 * counts.sum()


def test_short_sets_that_share_a_value_do_not_meet():
    """Sets of fewer than ten values have no similar set but themselves."""
    sets = [np.array([1, *range(10 * i, 10 * i + 7)]) for i in range(1, 200)]
    assert len(np.unique(np.concatenate([prefix_tree.branches(s, 90) for s in sets]))) == sum(len(prefix_tree.branches(s, 90)) for s in sets)


def test_join_spread_is_a_left_join(spark):
    rows = spark.createDataFrame([(i % 7 if i % 11 else None, i) for i in range(500)], "k long, part long")
    table = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, v string")
    hot = spark.createDataFrame([(2,), (6,)], "k long")
    got = join_spread(rows, table, "k", hot, 4).collect()
    assert sorted((r["part"], r["k"], r["v"]) for r in got) == sorted((i, k, f"v{k}" if k is not None and k < 5 else None) for i in range(500) for k in [i % 7 if i % 11 else None])
