"""Operator 5: SimHash near-deduplication with Golay-code keys.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code
(23, 12, 7) with leading zeros.  Two fingerprints that differ in at most two bits agree on some segment, and differ in
at most one bit on the segment after it: with no error in two segments, or none in one and one in each other.  Words
that differ in one bit share a key if each takes as keys its nearest codeword and, where that is three bits away, the
five codewords four bits away.  So a fingerprint gets, for each of its segments, that segment's bits with each key of
the next one, 16 keys in all, and fingerprints that share a key are compared.

Distinct fingerprints are joined, never documents.  A key that more than ``bucket`` fingerprints share is not paired:
its fingerprints take another exact way, on which each lists the 65 words at most one bit from it.  Two words differ in
at most two bits if and only if these lists meet, and a listed word belongs to 65 lists at most.

``drop_near_duplicates`` looks for texts at a Jaccard similarity.  Two bits lose many of those pairs, so MinHash bands
bring the others, and exact sets of shingles decide.

Null text and text without words have the fingerprint zero and link like any other; null ids never are the smallest;
rows that repeat an id or text are rows of one component; an empty table gives an empty result.  Other columns are not
read, but pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import jaccard
from barweave.llm.common import lower_ascii, read_table, split_by, stage, unused
from barweave.llm.components import components

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit, bits
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """Every n words in sequence, space-joined; of fewer words, the whole sequence."""
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(n)))]


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; a signed long."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([simhash(shingle_hashes(t, words)) for t in part], dtype="int64")

    return docs.withColumn(name, of(F.col("text")))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for shift in range(22, 10, -1):
        rest = np.where(rest >> shift & 1, rest ^ (GENERATOR << (shift - 11)), rest)
    return rest


class Golay:
    """For each syndrome the error patterns to take off a word: the least one, and of weight three the five of weight
    four beside it, with the least repeated where there are none."""

    def __init__(self) -> None:
        bits = 1 << np.arange(23)
        near = np.zeros((2048, 6), np.int64)
        single = [np.zeros(1, np.int64)]
        for weight in (1, 2, 3, 4):
            known = single[-1]
            top = np.where(known > 0, np.floor(np.log2(np.maximum(known, 1))).astype(int) + 1, 0)
            single.append(np.concatenate([k | bits[t:] for k, t in zip(known, top)]))
        for weight in (0, 1, 2, 3):
            near[_syndromes(single[weight])] = single[weight][:, None]
        three, four = single[3], single[4]
        own = _syndromes(four)
        order = np.argsort(own, kind="stable")
        place = np.arange(len(four)) - np.searchsorted(own[order], own[order])
        heavy = np.isin(own[order], _syndromes(three)) & (place < 5)
        near[own[order][heavy], place[heavy] + 1] = four[order][heavy]
        self.near = near

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Indices (the 12 information bits) of the codewords near each word, six a word; some may be equal."""
        return (words[:, None] ^ self.near[_syndromes(words)]) >> 11


def golay_keys(fps: DataFrame) -> DataFrame:
    """fp and key for each key of distinct fingerprints."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Golay()
        for batch in batches:
            fp = batch["fp"].to_numpy()
            word = fp.astype(np.uint64)
            parts = [(word >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
            for i in range(3):
                near = np.sort(code.keys(parts[(i + 1) % 3]), axis=1)
                new = np.ones(near.shape, bool)
                new[:, 1:] = near[:, 1:] != near[:, :-1]
                key = (i << 40) | (parts[i][:, None] << 12) | near
                yield pd.DataFrame({"fp": np.repeat(fp, 6)[new.ravel()], "key": key.ravel()[new.ravel()]})

    return fps.select("fp").mapInPandas(keyed, "fp long, key long")


def near_links(fps: DataFrame, bucket: int = 32) -> DataFrame:
    """u, v: links whose components are those of all pairs of the distinct fingerprints at two differing bits or fewer."""
    keys = stage(golay_keys(fps), "keys")
    sizes = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    small = keys.join(sizes.where(F.col("n") <= bucket), "key").select("key", "fp")
    pairs = small.alias("a").join(small.alias("b"), "key").where(F.col("a.fp") < F.col("b.fp")).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    close = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    crowded = keys.join(sizes.where(F.col("n") > bucket), "key", "left_semi").select("fp").distinct()
    bits = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint") for i in range(64)])
    ball = stage(crowded.select("fp", F.explode(F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b))).alias("word")), "balls")
    centre = ball.groupBy("word").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    around = ball.join(centre, "word").where("fp != v").select(F.col("fp").alias("u"), "v")
    return close.unionByName(around).distinct()


def near_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable, of every row."""
    marked = stage(fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), words).select("doc_id", "fp"), "fingerprints")
    least = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(least))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(ids, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles in sequence, repeats included."""
    parts = shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), words)
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in parts], "<u8").view("<i8")


def _digest() -> Column:
    return F.xxhash64(F.md5(lower_ascii(F.coalesce("text", F.lit(""))).cast("binary")))


def _row_key(node: str) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1).cast("bigint")), F.col("doc_id").isNull(), F.col(f"`{node}`"))


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, signature: int = 80, recall: float = 0.9999) -> DataFrame:
    """doc_id, node (a hash of the lower-cased text) and component (of nodes) of every row of docs.

    The components are those of pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least
    ``similarity``.  Pairs to verify come from two sides: fingerprints of the shingles at two differing bits or fewer, by
    their Golay keys, and, as many similar pairs lie further apart than that, MinHash bands tuned to ``recall``.  Texts
    are read again for the pairs that are left, one row of each text, and no others are exchanged.
    """
    bands, rows = jaccard.tune(similarity, signature, recall)

    @F.pandas_udf("struct<k:int,fp:long,bits:array<long>,keys:array<long>>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        banded = jaccard.MinHash(bands, rows)
        for part in batches:
            made = []
            for text in part:
                hashes = shingle_hashes(text, words)
                once = np.unique(hashes)
                made.append((len(once), simhash(hashes), jaccard.parities(once), banded.keys(once)))
            yield pd.DataFrame(made, columns=["k", "fp", "bits", "keys"])

    @F.pandas_udf("array<long>")
    def set_of(part: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)) for t in part])

    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest().alias("node"), measure("text").alias("x"))
    marked = stage(marked.select("doc_id", "node", _row_key("node").alias("row"), "x.*"), "marked")
    firsts = [F.first(c).alias(c) for c in ("k", "fp", "bits", "keys")]
    texts = stage(marked.groupBy("node").agg(F.min("row").alias("row"), *firsts), "texts")

    def sets_of(nodes: DataFrame) -> DataFrame:
        asked = stage(texts.join(nodes, "node").select(F.col("row").alias("_row"), F.col("node").alias("_node")), "rows")
        own = docs.select("doc_id", "text", _digest().alias("node")).select(_row_key("node").alias("row"), "node", "text")
        likely = split_by(own, "row", asked.select("_row"))[1]
        hit = likely.join(asked, (F.col("row") == F.col("_row")) & (F.col("node") == F.col("_node")))
        return hit.select("node", set_of("text").alias("s")).dropDuplicates(["node"])

    prints = stage(texts.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "prints")
    side = lambda name: prints.select(F.col("fp").alias(name), F.col("least").alias(f"_{name}"))
    near = near_links(prints.select("fp")).join(side("u"), "u").join(side("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    same = texts.select("fp", "node").join(prints.where("n > 1"), "fp").where("node != least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    links = jaccard.similar_links(jaccard.buckets(texts.select("node", "k", "bits", "keys")), sets_of, similarity, near.unionByName(same))
    linked = components(links).select(F.col("node").alias("_n"), "root")
    return marked.select("doc_id", "node").join(linked, F.col("node") == F.col("_n"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("component"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id; of rows alike in id and text, one.

    Rows that surely stay are not exchanged; the others meet the list of what goes."""
    found = stage(similar_components(docs, words, similarity).select("doc_id", "node", "component", _row_key("node").alias("row")), "found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m"))
    stay = first.select(F.col("m.row").alias("stays"))
    copies = found.groupBy("row").agg(F.count("*").alias("n")).join(stay, F.col("row") == F.col("stays"), "left")
    node, row = (unused(docs.columns, c) for c in ("node", "row"))
    gone, stays = (unused([*docs.columns, row], c) for c in ("gone", "stays"))
    moot = stage(copies.where("stays is null or n > 1").select(F.col("row").alias(gone), F.col("stays").isNotNull().alias(stays)), "moot")
    own = docs.withColumn(node, _digest()).withColumn(row, _row_key(node)).drop(node)
    sure, rest = split_by(own, row, moot.select(gone))
    rest = stage(rest, "rest")
    names = [F.col(f"`{c}`") for c in docs.columns]
    clear = rest.join(moot, F.col(row) == F.col(gone), "left_anti")
    once = rest.join(moot.where(stays), F.col(row) == F.col(gone), "left_semi").dropDuplicates([row])
    return sure.select(*names).unionByName(clear.select(*names)).unionByName(once.select(*names))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 on all documents."""
    found = near_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
