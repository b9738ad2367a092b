"""All links at a Jaccard similarity between sets of shingle hashes that share a MinHash band.

Bands are tuned for recall: ``tune`` takes the most rows, so the fewest collisions by chance, at which sets at the
similarity asked for still share a band with the probability ``recall``.

A bucket is the sets of one band.  Small ones are paired in full.  In a crowded one a lead meets all others, the same for
all buckets that it is in; a bucket whose sets are all linked to it is done with, as only components are asked for.  In
the others 16 more leads each are taken, pairs that are in one component by then need no look, and what is left after
these rounds (``leads``) is paired in full across components.  Nothing is skipped: a crowded bucket whose members are neither
linked nor told apart by size and bits costs the square of its size.

Size and bits tell pairs apart without the sets: in their parities no more differ than the sets have elements that are in
one alone, at the similarity asked for at most (1 - similarity) / (1 + similarity) of both sizes together.  The sets
themselves are asked for by node, for the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import split_by, stage
from barweave.llm.components import rooted, stars


def tune(similarity: float, signature: int, recall: float) -> tuple[int, int]:
    """bands, rows."""
    rows = 1
    while 1 - (1 - similarity ** (rows + 1)) ** (signature // (rows + 1)) >= recall:
        rows += 1
    return signature // rows, rows


class MinHash:
    """Keys of bands: of each band the hash of its rows' least hashes."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.Generator(np.random.PCG64(7))
        self.bands, self.rows = bands, rows
        self.odd = (rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.mix = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)

    def keys(self, hashes: np.ndarray) -> list[int]:
        """Signed longs; sets without elements share all of theirs."""
        least = np.full(len(self.odd), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 4096):
            part = hashes[None, i : i + 4096].astype(np.uint64)
            for low in range(0, len(least), 16):
                block = slice(low, low + 16)
                turned = (part ^ self.mix[block]) * self.odd[block]
                least[block] = np.minimum(least[block], (turned >> np.uint64(16)).min(1))
        return [xxhash.xxh64_intdigest(least[b * self.rows : (b + 1) * self.rows].tobytes(), b) >> 1 for b in range(self.bands)]


    def many(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keys of sets that stand one after the other in hashes, none of them empty: a row of keys each."""
        starts = np.append(0, ends[:-1])
        least = np.empty((len(ends), len(self.odd)), np.uint64)
        for i, (odd, mix) in enumerate(zip(self.odd[:, 0], self.mix[:, 0])):
            least[:, i] = np.minimum.reduceat(((hashes.astype(np.uint64) ^ mix) * odd) >> np.uint64(16), starts)
        width = 8 * self.rows
        raw = least.tobytes()
        keys = [xxhash.xxh64_intdigest(raw[i : i + width], (i // width) % self.bands) >> 1 for i in range(0, len(raw), width)]
        return np.array(keys, np.int64).reshape(len(ends), self.bands)


def parities(hashes: np.ndarray, longs: int = 8) -> np.ndarray:
    """For each of 64 * longs classes of hashes, whether an odd number is in the set."""
    return parities_of_many(hashes, np.array([len(hashes)]), longs)[0]


def parities_of_many(hashes: np.ndarray, ends: np.ndarray, longs: int) -> np.ndarray:
    """A row of parities for each of the sets that stand one after the other in hashes."""
    bits = 64 * longs
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) * bits
    place = ((hashes.astype(np.uint64) >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(own + place, minlength=bits * len(ends)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(ends), bits), axis=1, bitorder="little").view("<i8")


def _possible(similarity: float, a: str, b: str) -> Column:
    low, high = F.least(f"{a}.k", f"{b}.k"), F.greatest(f"{a}.k", f"{b}.k")
    apart = F.aggregate(F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (low >= similarity * high - 1e-6) & (apart <= (1 - similarity) / (1 + similarity) * (low + high) + 1e-6)


def alike(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Of the pairs u, v (leads before others, if some node is in very many) those whose sets are similar."""
    pairs = stage(pairs.select("u", "v").distinct(), "meet")
    nodes = stage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "asked")
    sets = stage(sets_of(nodes), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), "s"), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("t")), "v")
    common = F.size(F.array_intersect("s", "t"))
    return stage(both.where(common >= similarity * (F.size("s") + F.size("t") - common)).select("u", "v"), "alike")


def buckets(nodes: DataFrame) -> DataFrame:
    """key, n (nodes that have it) and m (node, k, bits) for each key that more than one node has; nodes: node, k, bits
    and keys, an array."""
    keys = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), F.struct("node", "k", "bits").alias("m"))
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    likely = split_by(keys, "key", shared.select("key"))[1]
    return stage(likely.join(shared, "key").select("key", "n", "m"), "members")


def similar_links(member: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, more: DataFrame | None = None, full: int = 8, leads: tuple[int, ...] = (1, 16), decide: Callable[..., DataFrame] = alike) -> DataFrame:
    """u, v: links whose components are those of all pairs that share a bucket and have the similarity.

    member: of ``buckets``; sets_of: node and s, the set, for a table of nodes; more: further pairs u, v to look at; decide:
    which of some pairs are similar, called like ``alike``."""
    small = member.where(F.col("n") <= full)
    pairs = small.select("key", F.col("m").alias("a")).join(small.select("key", F.col("m").alias("b")), "key").where("a.node < b.node")
    meet = pairs.where(_possible(similarity, "a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    if more is not None:
        meet = meet.unionByName(more.select("u", "v"))
    crowd, links = stage(member.where(F.col("n") > full).select("key", "m", F.col("m.node").alias("root")), "crowd"), None
    for turn, many in enumerate(leads):
        # one lead is the same for all buckets that it is in, several are each bucket's own, which spreads them
        turned = F.xxhash64("m.node", F.lit(turn)) if many == 1 else F.xxhash64("m.node", "key", F.lit(turn))
        place = F.row_number().over(Window.partitionBy("key").orderBy(turned))
        lead = stage(crowd.withColumn("place", place).where(F.col("place") <= many).select("key", F.col("m").alias("a"), F.col("root").alias("lead")), "leads")
        led = crowd.join(lead, "key").where("m.node != a.node and root != lead")
        pairs = led.where(_possible(similarity, "a", "m")).select(F.col("a.node").alias("u"), F.col("m.node").alias("v"))
        found = decide(pairs if turn else meet.unionByName(pairs), sets_of, similarity)
        links = found if links is None else links.unionByName(found)
        if many == 1:
            # members that are not linked to the lead of a bucket leave it open
            rest = led.join(found.select(F.col("u").alias("_u"), F.col("v").alias("_v")), (F.col("a.node") == F.col("_u")) & (F.col("m.node") == F.col("_v")), "left_anti")
            open_ = stage(rest.select("key").distinct(), "open")
            if open_.isEmpty():
                return links
            crowd = crowd.join(open_, "key", "left_semi")
        links = stars(links)
        roots = rooted(links).withColumnRenamed("root", "now")
        led = lead.select(F.col("key").alias("_key"), F.col("a.node").alias("_lead"))
        rest = crowd.join(led, (F.col("key") == F.col("_key")) & (F.col("m.node") == F.col("_lead")), "left_anti").select("key", "m")
        rest = stage(rest.join(roots, F.col("m.node") == F.col("node"), "left").select("key", "m", F.coalesce("now", "m.node").alias("root")), "crowd")
        split = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
        crowd = stage(rest.join(split, "key", "left_semi"), "crowd")
        if crowd.isEmpty():
            return links
    pairs = crowd.select("key", F.col("m").alias("a"), F.col("root").alias("aroot")).join(crowd.select("key", F.col("m").alias("b"), "root"), "key")
    pairs = pairs.where("a.node < b.node and root != aroot").where(_possible(similarity, "a", "b"))
    return links.unionByName(decide(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), sets_of, similarity))
