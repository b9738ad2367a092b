"""Operator 6: substring deduplication by MinHash banding of paragraphs.

A paragraph is a line of ``min_words`` words or more.  Its set of
five-word shingles gets a MinHash signature of bands * rows values, and paragraphs that agree on a band collide.  Bands
are tuned for recall (see jaccard): as many rows as still give it within the signature.  Colliding paragraphs are compared
by the exact Jaccard similarity of their shingle sets, links make components, and in each component all paragraphs but
the first (least doc_id, then place) are marked for removal.

Equal paragraphs are one from the start, by digest.  In a band's bucket no pair at the similarity is skipped: small ones
are paired in full, crowded ones as jaccard says.

A passage may also repeat inside longer lines, or across lines that are wrapped elsewhere.  So texts are cut into units
of 25 words besides, across lines, which start where the hash of three words is the least of 26 in sequence: whatever
stands around it, a passage of 50 words or more holds a whole unit and its copies hold the same.  Units with equal words
repeat; near copies are found as far as such units agree.  Of the repeats those that add to the paragraphs are merged to
spans: units in sequence that have the same first document and the same verdict.  A unit that overlaps its own first
stays.  Spans are listed once for rows that repeat both id and text.

Null and empty texts have no paragraphs, null ids count after all others, rows that repeat an id are read each, an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.llm import jaccard
from barweave.llm.common import read_table, split_by, stage
from barweave.llm.components import components

UNIT, WINDOW, GRAM = 25, 26, 3
LONGS = 2  # of parities of a paragraph


def paragraphs(docs: DataFrame, words: int, min_words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, own (the hash of the whole text), start, stop (code points), digest, k, bits and keys of every paragraph."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        banded, places = jaccard.MinHash(bands, rows), Words()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for ids, texts in _chunks(batches):
            raw, ends = _joined(texts)
            starts, stops, hashes = places.of(raw)
            breaks = np.flatnonzero(raw == 10)
            # the words of each line, a text's last line ends at the break that follows the text
            upto = np.searchsorted(starts, breaks)
            counts = np.diff(upto, prepend=0)
            long = np.flatnonzero(counts >= min_words)
            upto, counts = upto[long], counts[long]
            begin = np.append(0, breaks + 1)[long]
            text_of = np.searchsorted(ends, begin, side="right")
            points = _points(raw)
            zero = points[np.append(0, ends)[text_of]]
            digests = [xxhash.xxh3_128_digest(b" ".join(raw[i:j].tobytes().lower().split())) for i, j in zip(starts[upto - counts].tolist(), stops[upto - 1].tolist())]
            fresh: dict[bytes, int] = {}
            for i, digest in enumerate(digests):
                if digest not in known:
                    fresh.setdefault(digest, i)
            if len(known) > 50_000:
                known = {d: known[d] for d in set(digests) if d in known}
            if fresh:
                chosen = np.fromiter(fresh.values(), np.int64, len(fresh))
                found, sizes = _shingle_sets(places, hashes, upto[chosen] - counts[chosen], counts[chosen], words)
                known.update(zip(fresh, zip(np.diff(sizes, prepend=0).tolist(), jaccard.parities_of_many(found, sizes, LONGS).tolist(), banded.many(found, sizes).tolist())))
            own = [_text_hash(t) for t in texts]
            at = text_of.tolist()
            out = ([ids[t] for t in at], [own[t] for t in at], points[begin] - zero, points[breaks[long]] - zero, digests)
            more = [known[d] for d in digests]
            columns = [pa.array(c, t) for c, t in zip(out, kinds)] + [pa.array([x[i] for x in more], t) for i, t in enumerate((pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own", "start", "stop", "digest", "k", "bits", "keys"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, "doc_id bigint, own bigint, start bigint, stop bigint, digest binary, k int, bits array<bigint>, keys array<bigint>")


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 1 << 18) -> Iterator[tuple[list, list]]:
    """Ids and texts of rows in sequence, of about ``size`` letters or one longer text."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            part = batch.slice(low, 200)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if texts and held + len(text or "") > size:
                    yield ids, texts
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(text)
                held += len(text or "")
    if texts:
        yield ids, texts


def _joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the texts, each with a line break after it, and where each ends, the break included."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), np.cumsum([len(x) + 1 for x in parts])


def _points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte, and before the end."""
    return np.append(0, np.cumsum((raw & 0xC0) != 0x80))


def _shingle_sets(places: Words, hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles, sorted, of runs of counts words from first, one run after the other, and where each ends."""
    number = np.maximum(counts - words + 1, 1)
    run_of = np.repeat(np.arange(len(first)), number)
    at = np.arange(len(run_of)) - np.repeat(np.cumsum(number) - number, number) + first[run_of]
    raw = places.runs(hashes, at, np.minimum(at + words, (first + counts)[run_of]))
    order = np.argsort(raw)
    order = order[np.argsort(run_of[order], kind="stable")]
    raw, run_of = raw[order], run_of[order]
    new = np.append(True, (raw[1:] != raw[:-1]) | (run_of[1:] != run_of[:-1]))
    return raw[new], np.cumsum(np.bincount(run_of[new], minlength=len(first)))


def _text_hash(text: str | None) -> int:
    """As xxhash64 of Spark."""
    made = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)
    return made - (1 << 64) if made >> 63 else made


def anchors(grams: np.ndarray) -> np.ndarray:
    """For every WINDOW hashes in sequence the place of the least, the first of equal ones."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    least, at, held = grams, np.arange(len(grams)), 1
    while held < WINDOW:
        step = min(held, WINDOW - held)
        later = least[step:] < least[:-step]
        least, at, held = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step]), held + step
    return at


class Words:
    """Places and hashes of the words of a text, whole arrays at a time.

    A word's hash is a polynomial in its bytes, A-Z as a-z, from sums up to each byte; so is a unit's in its words."""

    STEP = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.table = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table[65:91] = self.table[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 2 * n
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(size, x, np.uint64)), dtype=np.uint64) for x in (self.STEP, pow(self.STEP, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    def runs(self, values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The hash of values from each start to its stop, wherever they stand."""
        up, down = self.powers(len(values) + 1)
        sums = np.append(np.uint64(0), np.cumsum(values * up[:-1], dtype=np.uint64))
        made = (sums[stops] - sums[starts]) * down[starts]
        made ^= made >> np.uint64(29)
        made *= np.uint64(0xBF58476D1CE4E5B9)
        return made ^ (made >> np.uint64(32))

    def of(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, stops (bytes) and hashes of the words of UTF-8 bytes."""
        edge = np.diff(np.concatenate(([True], self.space[raw], [True])).astype(np.int8))
        starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        return starts, stops, self.runs(self.table[raw], starts, stops)


def units(docs: DataFrame) -> DataFrame:
    """doc_id, own (see paragraphs), start, stop, line (the start of the line that holds it all, else -1) and unit, its hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for ids, texts in _chunks(batches):
            raw, ends = _joined(texts)
            starts, stops, hashes = words.of(raw)
            text_of = np.searchsorted(ends, starts, side="right")
            # windows of one text alone
            least = anchors(words.runs(hashes, np.arange(max(len(hashes) - GRAM + 1, 0)), np.arange(GRAM, max(len(hashes) + 1, GRAM))))
            begins = np.arange(len(least))
            at = np.unique(least[text_of[begins] == text_of[begins + WINDOW + GRAM - 2]])
            at = at[at + UNIT <= len(hashes)]
            enough = np.bincount(text_of, minlength=len(texts)) >= UNIT + WINDOW - 1
            at = at[(text_of[at] == text_of[at + UNIT - 1]) & enough[text_of[at]]]
            text_of = text_of[at]
            points = _points(raw)
            zero = points[np.append(0, ends)[text_of]]
            first, last = starts[at], stops[at + UNIT - 1]
            breaks = np.flatnonzero(raw == 10)
            line = np.searchsorted(breaks, first)
            begin = points[np.append(0, breaks + 1)[line]] - zero
            own = [_text_hash(t) for t in texts]
            where = text_of.tolist()
            hashed = (words.runs(hashes, at, at + UNIT) >> np.uint64(1)).astype(np.int64)
            columns = ([ids[t] for t in where], [own[t] for t in where], points[first] - zero, points[last] - zero, np.where(line == np.searchsorted(breaks, last), begin, -1), hashed)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "own", "start", "stop", "line", "unit"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, "doc_id bigint, own bigint, start bigint, stop bigint, line bigint, unit bigint")


def repeated_spans(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, start, stop, cluster_id and removed of spans of repeated units that paragraphs (marked) do not hold."""
    found = stage(units(docs), "units")
    often = stage(found.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1").select("unit"), "often")
    likely = split_by(found, "unit", often)[1].distinct()
    likely = stage(likely, "likely")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    first = stage(likely.groupBy("unit").agg(F.min(F.struct(place.alias("p"), "stop", "own")).alias("m"), F.count("*").alias("n")).where("n > 1"), "first")
    member = likely.join(first.select("unit", "m"), "unit")
    there = F.col("doc_id").eqNullSafe(F.col("m.p.doc_id")) & (F.col("own") == F.col("m.own")) & (F.col("start") < F.col("m.stop"))
    member = member.select("doc_id", "own", "start", "stop", "line", F.col("m.p.doc_id").alias("cluster_id"), (~there).alias("removed"))
    lines = marked.select(F.col("doc_id").alias("_doc"), F.col("own").alias("_own"), F.col("start").alias("_start"), F.col("removed").alias("_removed")).distinct()
    held = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own")) & (F.col("line") == F.col("_start")) & (F.col("_removed") | ~F.col("removed"))
    extra = member.join(lines, held, "left_anti")
    text = Window.partitionBy("doc_id", "own", "cluster_id", "removed").orderBy("start", "stop")
    before = F.max("stop").over(text.rowsBetween(Window.unboundedPreceding, -1))
    split = extra.withColumn("new", F.when(before >= F.col("start") - 1, 0).otherwise(1)).withColumn("part", F.sum("new").over(text))
    spans = split.groupBy("doc_id", "own", "cluster_id", "removed", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.select("doc_id", "start", "stop", "cluster_id", "removed")


def _row(doc: str, own: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc), F.lit(-1).cast("bigint")), F.col(doc).isNull(), F.col(own))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and s, the shingle set, of the wanted paragraphs (doc_id, own, start, stop, node, digest), read from the texts
    again; the texts that surely have none are not exchanged."""
    places = F.collect_list(F.struct("start", "stop", "node", "digest")).alias("want")  # paragraphs of one text
    grouped = stage(wanted.groupBy(_row("doc_id", "own").alias("_row")).agg(places), "wanted")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own")).select("text", _row("doc_id", "own").alias("row"))
    texts = split_by(own, "row", grouped.select("_row"))[1].join(grouped, F.col("row") == F.col("_row")).select("text", "want")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Words()
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                nodes, sets = [], []
                for text, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w in want:
                        line = (text or "")[w["start"] : w["stop"]].encode("utf-8", "surrogatepass")
                        if xxhash.xxh3_128_digest(b" ".join(line.lower().split())) == w["digest"]:
                            hashes = places.of(np.frombuffer(line, np.uint8))[2]
                            nodes.append(w["node"])
                            sets.append(_shingle_sets(places, hashes, np.array([0]), np.array([len(hashes)]), words)[0].view("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return texts.mapInArrow(take, "node bigint, s array<bigint>").dropDuplicates(["node"])


def duplicate_paragraphs(docs: DataFrame, words: int = 5, similarity: float = 0.8, min_words: int = 15, signature: int = 36, recall: float = 0.9995) -> DataFrame:
    """doc_id, start, stop, cluster_id and removed of every paragraph that has a duplicate, and of repeated spans
    besides; cluster_id is the least doc_id of the component."""
    bands, rows = jaccard.tune(similarity, signature, recall)
    found = stage(paragraphs(docs, words, min_words, bands, rows), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    kept = [F.first(c).alias(c) for c in ("k", "bits", "keys")]
    ordered = found.groupBy("digest").agg(F.min(F.struct(place.alias("p"), "stop", "own")).alias("m"), F.count("*").alias("n"), *kept)
    distinct = ordered.select("digest", F.xxhash64("digest").alias("node"), F.col("m.p.doc_id").alias("doc_id"), F.col("m.own").alias("own"), F.col("m.p.start").alias("start"), F.col("m.stop").alias("stop"), "n", "k", "bits", "keys")
    distinct = stage(distinct, "distinct")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return _sets(docs, distinct.select("doc_id", "own", "start", "stop", "node", "digest").join(nodes, "node"), words)

    roots = components(jaccard.similar_links(jaccard.buckets(distinct.select("node", "k", "bits", "keys")), sets_of, similarity))
    named = distinct.select("node", "digest", "n", "doc_id", "start").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    named = named.select("digest", "n", "doc_id", "start", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min(place).alias("first"), F.sum("n").alias("size")).where("size > 1")
    clusters = stage(named.join(first, "root").select("digest", F.xxhash64("digest").alias("node"), "first"), "clusters")
    likely = split_by(found.select("doc_id", "own", "start", "stop", "digest", F.xxhash64("digest").alias("_node")), "_node", clusters.select("node"))[1]
    member = likely.drop("_node").join(clusters.drop("node"), "digest")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))
    marked = stage(member.select("doc_id", "own", "start", "stop", F.col("first.doc_id").alias("cluster_id"), (~same).alias("removed")), "marked")
    return marked.drop("own").unionByName(repeated_spans(docs, marked))


def op6_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 on all documents."""
    return duplicate_paragraphs(read_table(spark, sf_dir, "documents"))
