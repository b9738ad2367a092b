"""Operator 11: n-gram Jaccard self-join by prefix trees.

A text's set of n-grams is an array of longs in one order that holds for all texts: an n-gram's frequency class, from counts
of 2**18 groups of n-grams over the whole corpus, then its hash.  Rare n-grams come first.  Any such order is right, so the
counts need not be exact, and they are of one size whatever the corpus.

Rare n-grams recur by chance in ever more sets as the corpus grows, so the tree does not branch by single ones: a set is dealt
into blocks of about four n-grams by their hash, as many blocks for all sets of a size class, and is a set of blocks in one order,
those of many and rare n-grams first.  An n-gram that is in one of two sets alone spoils one block, so similar sets share one
of their first blocks, one more than the n-grams in which they may differ.  These are the branches at the root of the tree of
all sets, one key each, and a branch that only one set has ends there.  Sets that meet in a branch are told apart by
their sizes and parities (``jaccard.py``; long sets have finer ones besides).  The sets that a set may be linked to are streamed to a task in chunks, and a
chunk makes a tree: it is walked with the set in hand, what is common down to a node is counted once for all sets below it,
and a subtree is left as soon as what remains of the sets below and in hand cannot reach the overlap asked for.

Equal sets are one node, so copies are never paired.  Branches with many sets go by leads, as only components are asked for,
and nothing is skipped (``jaccard.py`` says how, and what it costs where members of a branch are neither linked nor told
apart).

Null text and text without words have no set and link with nothing; fewer words than n are one n-gram of their own.  Rows
that repeat an id have sets of their own, null ids never are the smallest, and a component of null ids alone has none.  An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import jaccard
from barweave.llm.common import LOWER, UPPER, join_spread, read_table, split_by, stage
from barweave.llm.components import components

#: Groups of n-grams that are counted, as a power of two: a table of 2 MB.
GROUPS = 18
#: N-grams of a chunk of sets that one tree holds (or one longer set).
CHUNK = 1 << 18
#: Sets of more n-grams have parities of about as many classes besides.
LONG = 1000
#: Rows or nodes of one key from which on they are spread.
OFTEN = 1000


class _Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


def gram_hashes(text: str | None, n: int, known: dict[bytes, int]) -> np.ndarray:
    """The hash of every n words in sequence of the lower-cased text, of fewer words that of all; repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(n, len(words))
    values = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ values[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def frequency_classes(docs: DataFrame, n: int) -> np.ndarray:
    """For each group of n-grams the class of its count over all docs: from 0 to 63, growing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known, held, size = np.zeros(1 << GROUPS, np.int64), _Hashes(), [], 0

        def add() -> None:
            total[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - GROUPS)).astype(np.int64), minlength=1 << GROUPS)

        for batch in batches:
            for text in batch.column(0):
                held.append(gram_hashes(text.as_py(), n, known))
                size += len(held[-1])
                if size > 1 << 20:
                    add()
                    held, size = [], 0
        if held:
            add()
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["at", "n"])

    counts = docs.select("text").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2**GROUPS rows at most
    total = np.zeros(1 << GROUPS, np.int64)
    total[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    return np.minimum(2 * np.log2(np.maximum(total, 1)), 63).astype(np.uint64)


def gram_set(text: str | None, n: int, classes: np.ndarray, known: dict[bytes, int]) -> np.ndarray:
    """The set of n-grams in the order that holds for all texts."""
    hashes = gram_hashes(text, n, known)
    return np.unique((classes[(hashes >> np.uint64(64 - GROUPS)).astype(np.int64)] << np.uint64(57)) | (hashes >> np.uint64(7))).view(np.int64)


def _node(found: np.ndarray) -> bytes:
    return hashlib.md5(found.tobytes(), usedforsecurity=False).digest()


def wide_parities(found: np.ndarray) -> bytes:
    """Whether an odd number of the set is in each class; classes are a power of two, about as many as the set has values."""
    classes = 1 << (len(found) - 1).bit_length()
    odd = np.bincount((found.view(np.uint64) >> np.uint64(8)).astype(np.int64) & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many classes two sets differ, so that as many values at least are in one alone; the finer one is folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def not_apart(pairs: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """pairs u, v without those of long sets (node, k, wide) that differ in more classes than similar ones can."""
    side = lambda name: long.select(F.col("node").alias(name), F.col("k").alias(f"k_{name}"), F.col("wide").alias(f"wide_{name}"))
    held = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
    both = F.col("k_u").isNotNull() & F.col("k_v").isNotNull()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = [apart(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5))]
            yes = (100 + percent) * np.array(differ, np.int64) <= (100 - percent) * sizes.astype(np.int64)
            yield batch.select([0, 1]).filter(pa.array(yes))

    near = held.where(both).select("u", "v", "k_u", "k_v", "wide_u", "wide_v").mapInArrow(keep, "u binary, v binary")
    return held.where(~both).select("u", "v").unionByName(near)


def branches(found: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which similar sets share one: the set's first blocks, by size classes.

    Sizes of similar sets are less than a step of the logarithm apart.  A class is two steps wide, and sets in its upper
    half are in the next class too.  There they meet sets of their step and larger ones, in their own class smaller ones only.
    Below 80 per cent blocks would often be empty, and first n-grams are taken in their place."""
    k, values = len(found), found.view(np.uint64)
    step = int(np.log(k) / (np.log(100 / percent) * (1 + 1e-9))) if percent < 100 else 2 * k
    classes = [step // 2, step // 2 + 1] if step % 2 else [step // 2]
    if percent < 80:
        first = values[: k + (-percent * k // 100) + 1]
        return np.concatenate([(first ^ np.uint64(c + 1)) * np.uint64(0x9E3779B97F4A7C15) for c in classes]).view(np.int64)
    mixed = values * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    place, rare = mixed >> np.uint64(32), 64 - (values >> np.uint64(57)).astype(np.int64)
    out = []
    for c in classes:
        largest = k if c < (step + 1) // 2 else 100 * k // percent
        differ = (100 - percent) * (k + largest) // (100 + percent)
        # a set that may differ in nothing is one block
        many = 2 + int(4 * (100 - percent) / (100 + percent) * (100 / percent) ** (2 * c + 1.5)) if differ else 1
        block = ((place * np.uint64(many)) >> np.uint64(32)).astype(np.int64)
        keys = np.zeros(many, np.uint64)
        np.add.at(keys, block, mixed)
        keys = (keys ^ (np.uint64(c + 1) << np.uint64(32)) ^ np.arange(many, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        weight = np.bincount(block, rare, many)
        out.append(keys[np.lexsort((keys, -weight))[: differ + 1]])
    return np.concatenate(out).view(np.int64)


def described(docs: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """doc_id, node (digest of the set), k (its size), bits (parities), wide (of long sets) and keys (branches) of every row;
    null where k is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [gram_set(text.as_py(), n, shared.value, known) for text in part.column(1)]
                ends = np.cumsum([len(s) for s in sets])
                bits = jaccard.parities_of_many(np.concatenate(sets), ends, 8)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([_node(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([b if len(s) else None for s, b in zip(sets, bits)], pa.list_(pa.int64())),
                        pa.array([wide_parities(s) if len(s) > LONG else None for s in sets], pa.binary()),
                        pa.array([branches(s, percent) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "node", "k", "bits", "wide", "keys"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(of, "doc_id bigint, node binary, k int, bits array<bigint>, wide binary, keys array<bigint>")


def sets_of(docs: DataFrame, asked: DataFrame, n: int, classes: np.ndarray) -> DataFrame:
    """node and s, its ordered set, of asked (node and doc_id, a document that has it)."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                sets = [gram_set(text.as_py(), n, shared.value, known) for text in batch.column(0).slice(low, 256)]
                yield pa.record_batch([pa.array([_node(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    asked = stage(asked, "asked")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    likely = split_by(rows, "doc_id", asked.where("doc_id is not null").select("doc_id").distinct())[1].unionByName(rows.where("doc_id is null"))
    return likely.select("text").mapInArrow(take, "node binary, s array<bigint>").join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"])


def linked(own: np.ndarray, others: list[np.ndarray], percent: int) -> list[bool]:
    """Which of others, ordered sets all different, are similar to own: a walk of the tree that they make."""
    out = [False] * len(others)
    order = sorted(range(len(others)), key=lambda i: others[i].astype(">i8").tobytes())
    sizes = np.array([len(others[i]) for i in order])
    # sets low to high - 1, in order, agree in their first depth values, of which overlap are in own
    todo = [(0, len(order), 0, 0)] if order else []
    while todo:
        low, high, depth, overlap = todo.pop()
        first, last = others[order[low]], others[order[high - 1]]
        upto = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:upto] != last[depth:upto]) if high - low > 1 else ()
        to = depth + int(differ[0]) if len(differ) else upto
        path = first[depth:to]
        rest = len(own)
        if to:
            at = np.searchsorted(own, path)
            overlap += int((own[np.minimum(at, len(own) - 1)] == path).sum())
            rest -= int(np.searchsorted(own, first[to - 1], "right"))
        below = sizes[low:high]
        best = overlap + min(rest, int(below.max()) - to)
        if (100 + percent) * best < percent * (len(own) + int(below.min())):
            continue
        if len(first) == to:
            out[order[low]] = (100 + percent) * overlap >= percent * (len(own) + to)
            low += 1
        while low < high:
            value, stop = others[order[low]][to], low + 1
            while stop < high and others[order[stop]][to] == value:
                stop += 1
            todo.append((low, stop, to, overlap))
            low = stop
    return out


def tree_links(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], long: DataFrame, percent: int) -> DataFrame:
    """Of the pairs u, v of nodes (one that is in very many as u) those whose sets are similar; sets: node and s, the ordered
    set, for a table of nodes."""
    pairs = stage(not_apart(stage(pairs.select("u", "v").distinct(), "pairs"), long, percent), "meet")
    held = sets(stage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "asked"))
    crowded = pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > OFTEN).select("u")
    few, many = split_by(pairs, "u", stage(crowded, "crowded"))
    dealt = few.withColumn("part", F.lit(0)).unionByName(many.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(64)).cast("int")))
    rows = dealt.unionByName(dealt.select("u", F.col("u").alias("v"), "part").distinct())
    rows = rows.join(held.select(F.col("node").alias("v"), "s"), "v")
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v") != F.col("u"), "v").select("u", "part", "v", "s")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, names, held, size, us, vs = None, None, [], [], 0, [], []

        def close() -> None:
            for name, yes in zip(names, linked(own, held, percent) if held else ()):
                if yes:
                    us.append(now[0])
                    vs.append(name)

        for batch in batches:
            keys, parts, others = (batch.column(i).to_pylist() for i in range(3))
            values, ends = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            for i, (u, part, v) in enumerate(zip(keys, parts, others)):
                one = values[ends[i] : ends[i + 1]]
                if (u, part) != now:
                    close()
                    now, own, names, held, size = (u, part), one.copy(), [], [], 0
                    continue
                if held and size + len(one) > CHUNK:
                    close()
                    names, held, size = [], [], 0
                names.append(v)
                held.append(one.copy())
                size += len(one)
            yield pa.record_batch([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])
            us, vs = [], []
        close()
        yield pa.record_batch([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    return stage(rows.mapInArrow(walk, "u binary, v binary"), "linked")


def without_repeats(member: DataFrame) -> DataFrame:
    """member (key, n, m) with one key of those that the same nodes have: near copies meet in many branches at once."""
    both = [F.bit_xor(F.xxhash64("m.node", F.lit(turn))).alias(f"x{turn}") for turn in (0, 1)]
    kept = member.groupBy("key", "n").agg(*both).groupBy("n", "x0", "x1").agg(F.min("key").alias("key"))
    return stage(member.join(stage(kept.select("key"), "kept"), "key", "left_semi"), "members")


def similar_sets(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_grams (size of its set) and component_id, the smallest doc_id that links of percent similarity lead to."""
    classes = frequency_classes(docs, n)
    rows = stage(described(docs, n, percent, classes), "described")
    nodes = rows.where("k > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    nodes = stage(nodes, "nodes")
    member = without_repeats(jaccard.buckets(rows.where("k > 0").select("node", "k", "bits", "keys").dropDuplicates(["node"])))
    sets = lambda asked: sets_of(docs, nodes.join(asked, "node", "left_semi").select("node", "doc_id"), n, classes)
    # few leads at first: later ones need to meet only sets of other components
    long = stage(rows.where("wide is not null").select("node", "k", "wide").dropDuplicates(["node"]), "long")
    links = jaccard.similar_links(member, sets, percent / 100, leads=(1, 2, 4, 8), decide=lambda pairs, of, _: tree_links(pairs, of, long, percent))
    roots = components(links)
    named = stage(nodes.join(roots, "node").select("node", "doc_id", "root"), "rooted")
    groups = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    groups = stage(groups, "groups")
    whole = join_spread(named.select("node", "root"), groups.select("root", "component_id"), "root", groups.where(F.col("n") > OFTEN).select("root"))
    whole = nodes.join(whole.select("node", F.col("component_id").alias("_found"), F.lit(True).alias("_has")), "node", "left")
    whole = stage(whole.select("node", F.when(F.col("_has"), F.col("_found")).otherwise(F.col("doc_id")).alias("component_id"), "copies"), "classes")
    some = rows.where("k > 0").select("doc_id", "k", "node")
    found = join_spread(some, whole.select("node", "component_id"), "node", whole.where(F.col("copies") > OFTEN).select("node"))
    found = found.select("doc_id", F.col("k").cast("bigint").alias("n_grams"), "component_id")
    return found.unionByName(rows.where("k = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_grams"), F.col("doc_id").alias("component_id")))


def op11_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 on all documents: three words, 90 per cent."""
    return similar_sets(read_table(spark, sf_dir, "documents")).withColumnRenamed("n_grams", "n_shingles")


OP11_SQL = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS grams
  FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
often AS (SELECT doc_id, n, gram FROM g SEMI JOIN (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1) USING (gram)),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM often a JOIN often b USING (gram)
  WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT DISTINCT x, x AS y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
component AS (SELECT x, min(y) AS least FROM reach GROUP BY x)
SELECT doc_id, len(grams) AS n_shingles, coalesce(least, doc_id) AS component_id FROM s LEFT JOIN component ON x = doc_id
"""
