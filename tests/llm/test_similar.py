"""Near copies at Jaccard 0.8 against brute force."""

import itertools

import numpy as np

from barweave.llm import simhash, substrings


def shingle_sets(texts):
    return {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}


def brute(sets, similarity=0.8):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        c = len(sets[a] & sets[b])
        if c >= similarity * (len(sets[a]) + len(sets[b]) - c):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def same_groups(got, want):
    return {frozenset(i for i in got if got[i] == g) for g in set(got.values())} == {frozenset(i for i in want if want[i] == g) for g in set(want.values())}


def components_of(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["component"] for r in simhash.similar_components(rows).collect()}


def test_pairs_near_the_limit_are_all_found(spark):
    """Texts of 90 to 130 words with one to six changed words: pairs on both sides of 0.8, many of them groups of two."""
    rng = np.random.default_rng(11)
    texts = {}
    for i in range(150):
        w = [f"v{x}" for x in rng.integers(0, 400, rng.integers(90, 130))]
        texts[2 * i] = " ".join(w)
        for k in rng.integers(0, len(w), rng.integers(1, 6)):
            w[k] = f"n{rng.integers(0, 10**6)}"
        texts[2 * i + 1] = " ".join(w)
    want = brute(shingle_sets(texts))
    assert 40 < len(texts) - len(set(want.values())) < 145
    assert same_groups(components_of(spark, texts), want)


def test_crowded_template(spark):
    """Variants of one template at 0.5 to 0.7, some of them in pairs at 0.8 or more."""
    rng = np.random.default_rng(12)
    base = [f"t{i}" for i in range(120)]
    texts = {}
    for i in range(600):
        w = list(base)
        for k in rng.choice(120, 7, replace=False):
            w[k] = f"x{rng.integers(0, 40)}"
        texts[2 * i] = " ".join(w)
        if i % 20 == 0:
            w[int(rng.integers(0, 120))] = "last"
            texts[2 * i + 1] = " ".join(w)
    assert same_groups(components_of(spark, texts), brute(shingle_sets(texts)))


def test_crowded_bands(spark):
    """A crowd of variants of one line at about 0.6: every pair of them at 0.85 is found, whoever leads its buckets."""
    rng = np.random.default_rng(13)
    texts = {}
    for i in range(700):
        w = [f"t{k}" for k in range(200)]
        for k in rng.choice(200, 10, replace=False):
            w[k] = f"x{rng.integers(0, 10**6)}"
        texts[2 * i] = " ".join(w)
        for k in rng.choice(200, 2, replace=False):
            w[k] = f"y{rng.integers(0, 10**6)}"
        texts[2 * i + 1] = " ".join(w)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    # whole lines: repeated units may start at 0 too
    got = {r["doc_id"]: r["cluster_id"] for r in substrings.duplicate_paragraphs(rows).where("start = 0").collect() if r["stop"] == len(texts[r["doc_id"]])}
    assert same_groups({i: got.get(i, i) for i in texts}, brute(shingle_sets(texts)))


def test_passage_inside_longer_lines(spark):
    """A passage of 51 words in lines of other words, in a text without line breaks and wrapped elsewhere."""
    rng = np.random.default_rng(14)

    def other(n):
        return " ".join(f"o{x}" for x in rng.integers(0, 10**6, n))

    words = [f"p{i}" for i in range(51)]
    passage = " ".join(words)
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, 51, 9))
    texts = {1: f"{other(200)} {passage} {other(150)}", 2: f"head\n{other(90)} {passage} {other(300)}\nend", 3: f"{other(40)}\n{wrapped}\n{other(40)}", 4: other(400)}
    got = substrings.duplicate_paragraphs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["cluster_id"], r["removed"]) for r in got} == {(1, 1, False), (2, 1, True), (3, 1, True)}
    assert all(set(texts[r["doc_id"]][r["start"] : r["stop"]].split()) <= set(words) and len(texts[r["doc_id"]][r["start"] : r["stop"]].split()) >= 25 for r in got)


def test_anchors_and_shingle_sets_in_whole_arrays():
    """Ties, runs shorter than a shingle and repeats of one, against loops."""
    rng = np.random.default_rng(15)
    for n in (0, 25, 26, 27, 300):
        grams = rng.integers(0, 12, n).astype(np.uint64)
        want = [i + int(np.argmin(grams[i : i + substrings.WINDOW])) for i in range(n - substrings.WINDOW + 1)]
        assert substrings.anchors(grams).tolist() == want
    text = " ".join(f"{'aB'[x]}" for x in rng.integers(0, 2, 200)).encode()
    places = substrings.Words()
    hashes = places.of(np.frombuffer(text, np.uint8))[2]
    words = text.lower().split()
    first, counts = np.array([0, 3, 60, 199]), np.array([3, 57, 139, 1])
    found, ends = substrings._shingle_sets(places, hashes, first, counts, 5)
    assert np.diff(ends, prepend=0).tolist() == [len({tuple(words[k : min(k + 5, f + c)]) for k in range(f, f + max(c - 4, 1))}) for f, c in zip(first, counts)]
    assert all((np.diff(found[i:j].astype(object)) > 0).all() for i, j in zip(np.append(0, ends), ends))
