"""Operator 13: periodic runs of words, by the method of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q whose length is at least ``shortest`` and ``exponent`` times q and that
no neighbouring word extends.  Of each text

1. a suffix automaton gives the factors: each is the longest prefix of the rest that occurs before, wherever it overlaps,
   with the place where it occurs first;
2. Main's tests at the factors' borders find, from prefixes and suffixes common to both sides of a border, the runs that
   touch one;
3. all other runs lie strictly inside a factor and are copied from where the factor occurred first.

With an exponent of three or more, words behind a run's first period equal the word one period before.  So a window of
``shortest * (1 - 1 / exponent)`` words recurs inside each run, every word of a run is in such a window, and only borders
beside a factor of half a window can matter.  Stretches that recurring windows cover are all that is factorised; hashes
find them, and equal hashes of different windows only make a stretch longer.  Nothing is left out.

Each text is one row's work, linear in its words; texts are neither grouped nor exchanged.  Null text and text without
words have no run and collapse to the empty string.  Null and repeated ids are rows of their own, an empty table gives an
empty result, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import read_table, words_of


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """start, stop and first occurrence's start (-1: a new letter) of each factor of w."""
    follow, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        made = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        first.append(i)
        link.append(0)
        at = last
        while at >= 0 and c not in follow[at]:
            follow[at][c] = made
            at = link[at]
        if at >= 0:
            q = follow[at][c]
            if length[q] == length[at] + 1:
                link[made] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[at] + 1)
                first.append(first[q])
                link.append(link[q])
                while at >= 0 and follow[at].get(c) == q:
                    follow[at][c] = twin
                    at = link[at]
                link[q] = link[made] = twin
        last = made
    out, i = [], 0
    while i < len(w):
        state, j = 0, i
        while j < len(w):
            to = follow[state][w[j]]
            if first[to] >= j:
                break
            state, j = to, j + 1
        out.append((i, j, first[state] - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = out[-1][1]
    return out


def _z(s: list[int]) -> list[int]:
    """For each place how long the rest agrees with the whole."""
    z, low, high = [0] * len(s), 0, 0
    if s:
        z[0] = len(s)
    for i in range(1, len(s)):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def _agree(pattern: list[int], text: list[int]) -> list[int]:
    """For each place of text how long the rest agrees with pattern."""
    return _z([*pattern, -1, *text])[len(pattern) + 1 :]


def runs_of(w: list[int], shortest: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """start, length and period of every run of w (ids from 0), by start, then period."""
    if exponent < 3:
        raise ValueError("an exponent of three or more is needed")
    n, half = len(w), _window(shortest, exponent) // 2
    parts, found = factors(w), {}

    def keep(start: int, stop: int, q: int) -> None:
        while start and w[start - 1] == w[start - 1 + q]:
            start -= 1
        while stop < n and w[stop] == w[stop - q]:
            stop += 1
        if stop - start >= max(shortest, exponent * q):
            # of periods of one stretch the smallest divides the others
            found[start, stop] = min(q, found.get((start, stop), q))

    for at in range(len(parts) + 1):
        c = parts[at][0] if at < len(parts) else n
        left = c - parts[at - 1][0] if at else 0
        right = parts[at][1] - c if at < len(parts) else 0
        if left < half and right < half:
            continue
        low = max(0, c - 2 * left - right)
        back = w[low:c][::-1]
        # periods that fit to the right of the border
        if right:
            ahead = _z(w[c : c + right])
            before = _agree(back, w[low : c + right][::-1])
            for q in range(1, right + 1):
                more, less = ahead[q] if q < right else 0, before[right - q]
                if more + less >= q * (exponent - 1) and more + less + q >= shortest:
                    keep(c - less, c + q + more, q)
        # periods that fit to its left
        if left:
            behind = _z(back)
            stop = min(n, c + left)
            beyond = _agree(w[c:stop], w[c - left : stop])
            for q in range(1, left + 1):
                more, less = beyond[left - q], behind[q] if q < len(back) else 0
                if more + less >= q * (exponent - 1) and more + less + q >= shortest:
                    keep(c - q - less, c + more, q)
    starts: dict[int, list[tuple[int, int]]] = {}
    for (start, stop), q in found.items():
        starts.setdefault(start, []).append((stop, q))
    for low, high, origin in parts:
        if origin < 0 or high - low < shortest or not starts:
            continue
        for k in range(1, high - low):
            for stop, q in list(starts.get(origin + k, ())):
                if stop < origin + high - low and (low + k, stop - origin + low) not in found:
                    found[low + k, stop - origin + low] = q
                    starts.setdefault(low + k, []).append((stop - origin + low, q))
    return sorted((start, stop - start, q) for (start, stop), q in found.items())


def _window(shortest: int, exponent: int) -> int:
    """Words in sequence that recur in every run."""
    return -(-shortest * (exponent - 1) // exponent)


def _stretches(ids: np.ndarray, ends: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Where windows that recur in one text stand, as places in ids; texts end at ends."""
    count = len(ids) - window + 1
    if count <= 0:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashed, width = np.zeros(count, np.uint64), 0
    power, rest = mixed, window  # power: hashes of the next power of two of words
    span = 1
    while rest:
        if rest & 1:
            hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + power[width : width + count]
            width += span
        rest >>= 1
        if rest:
            power = power[:-span] * np.uint64(0xBF58476D1CE4E5B9) + (power[span:] ^ (power[span:] >> np.uint64(31)))
            span *= 2
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = own[:count] == own[window - 1 :]
    hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + own[:count].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    hashed = hashed[inside]
    order = np.sort(hashed)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return []
    again = np.unique(again)
    place = np.minimum(np.searchsorted(again, hashed), len(again) - 1)
    at = np.flatnonzero(inside)[again[place] == hashed]
    # a stretch goes on while the next window starts in it or right behind it, in the same text
    new = np.flatnonzero((at[1:] > at[:-1] + window) | (own[at[1:]] != own[at[:-1]]))
    return list(zip(at[np.append(0, new + 1)].tolist(), (at[np.append(new, len(at) - 1)] + window).tolist()))


class _Ids(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _runs_of_many(texts: list[list[bytes]], shortest: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    known = _Ids()
    ends = np.cumsum([len(words) for words in texts]).astype(np.int64)
    ids = np.fromiter((known[word] for words in texts for word in words), np.int64, int(ends[-1]) if len(ends) else 0)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in _stretches(ids, ends, _window(shortest, exponent)):
        text = int(np.searchsorted(ends, low, "right"))
        at = low - (int(ends[text - 1]) if text else 0)
        out[text] += [(at + start, length, q) for start, length, q in runs_of(ids[low:high].tolist(), shortest, exponent)]
    return out


def periodic_runs(docs: DataFrame, shortest: int = 24, exponent: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start and length in words, period; by start, then period) and collapsed: the words that no run
    holds behind its first period, joined by spaces."""
    triple = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                texts, held, high = [], 0, low
                while high < batch.num_rows and held < 1 << 17:  # about so many words at once, or one longer text
                    texts.append((batch.column(1)[high].as_py() or "").encode().split())
                    held += len(texts[-1])
                    high += 1
                found = _runs_of_many(texts, shortest, exponent)
                collapsed = []
                for words, runs in zip(texts, found):
                    if runs:
                        keep = np.ones(len(words), bool)
                        for start, length, q in runs:
                            keep[start + q : start + length] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    collapsed.append(b" ".join(words).decode())
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array([len(words) for words in texts], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found], triple),
                        pa.array(collapsed, pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                low = high

    schema = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(find, schema)


def periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in texts whose id's checksum is a multiple of ten, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string"))
    words, g = words_of(F.col("text")), F.floor(h / 10)
    n = F.size(words)
    numbered = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    n = F.size("words")
    a = F.col("g") % n
    numbered = numbered.withColumn("a", F.when(n > 0, a))
    numbered = numbered.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))))
    index = F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    turned = F.array_join(F.transform(index, lambda i: F.get("words", place(i).cast("int"))), " ")
    return numbered.select("doc_id", F.when(F.col("words").isNotNull() & (n > 0), turned).otherwise(F.col("text")).alias("text"))


def _greatest(runs: str) -> Column:
    """The run of greatest length / period, of several the first."""
    before = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, run: F.when(before(best, run), run).otherwise(best))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 on all documents, some of them made periodic: their runs, the greatest of them, and digests of all runs
    and of the text without repeats.  A row without id is left as it is."""
    found = periodic_runs(periodic_tails(read_table(spark, sf_dir, "documents"))).withColumn("best", _greatest("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
