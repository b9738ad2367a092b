"""Operator 3: line deduplication with a fixed-depth log-template tree.

A line's words pass a tree of fixed depth: first by their number, then by the leading ``depth`` words, in which words
with digits count as a variable field.  Below a leaf a word is constant at its position if at least ``min_docs`` rows have
it there in that leaf, else the position is a variable field; what is left is the line's template.  A template is
recurring if at least ``min_docs`` texts have it and at least ``min_constant`` of its words are constant; in lines of
fewer than ``short`` words all words must be.

Copies of whole documents repeat all their lines, which are text and no boilerplate.  So equal texts count once, and
texts most of whose words lie in recurring templates do not count as evidence: a template must recur in ``min_docs`` of
the others.  Lines of templates that pass are dropped wherever they stand.

A line is two hashes from the start.  Its words are looked at only where its leaf may recur: there each different line is
exchanged once, and its words as hashes, which are combined before every exchange.  Of the texts those are exchanged that
may lose a line, once, to meet the lines that they lose.

Null text stays null, empty lines and lines of white space stay; ids are not read, so null and repeated ones change
nothing; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import join_spread, read_table, split_by, stage, unused

FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")
_NUMBER = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*")


def masked_words(line: bytes) -> list[bytes]:
    """The words of a line; those with digits are fields."""
    return (_NUMBER.sub(FIELD, line) if _DIGIT.search(line) else line).split()


def leaf(words: list[bytes], depth: int) -> bytes:
    return xxhash.xxh64_digest(b"%d " % len(words) + b" ".join(words[:depth]))


def pattern(words: list[bytes]) -> bytes:
    """The name of lines that have the same words."""
    return xxhash.xxh64_digest(b" ".join(words))


def _longs(digests: list[bytes]) -> pa.Array:
    return pa.array(np.frombuffer(b"".join(digests), ">i8").astype("<i8"))


def line_patterns(docs: DataFrame, depth: int) -> DataFrame:
    """own (the hash of the text), leaf, pattern, words (those of all its lines in the text), whole (those of the text): a
    row for each pattern of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                own, leaves, keys, words, whole = [], [], [], [], []
                for text in batch.slice(low, 500).column(0).to_pylist():
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    made, times, total = {}, Counter(), 0
                    for line in raw.split(b"\n"):
                        if found := masked_words(line):
                            total += len(found)
                            times[key := pattern(found)] += len(found)
                            if key not in made:
                                made[key] = leaf(found, depth)
                    own += [xxhash.xxh64_intdigest(raw, 42)] * len(made)
                    whole += [total] * len(made)
                    keys += made
                    leaves += made.values()
                    words += [times[key] for key in made]
                plain = [pa.array(np.array(own, "<u8").view("<i8")), _longs(leaves), _longs(keys), pa.array(words, pa.int32()), pa.array(whole, pa.int32())]
                yield pa.RecordBatch.from_arrays(plain, ["own", "leaf", "pattern", "words", "whole"])

    return docs.select("text").mapInArrow(cut, "own bigint, leaf bigint, pattern bigint, words int, whole int")


def line_words(docs: DataFrame, depth: int) -> DataFrame:
    """leaf, pattern and words (masked, with one space between) of lines; of 500 texts each pattern once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                leaves, made = [], {}
                for text in batch.slice(low, 500).column(0).to_pylist():
                    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
                        if (found := masked_words(line)) and (key := pattern(found)) not in made:
                            made[key] = b" ".join(found)
                            leaves.append(leaf(found, depth))
                yield pa.RecordBatch.from_arrays([_longs(leaves), _longs(list(made)), pa.array(list(made.values()), pa.binary())], ["leaf", "pattern", "words"])

    return docs.select("text").mapInArrow(cut, "leaf bigint, pattern bigint, words binary")


def recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 10, min_constant: float = 0.6, short: int = 4, mostly: float = 0.5, hot: int = 100_000) -> DataFrame:
    """own (xxhash64 of the text) and pattern of every line of a recurring template, once a text.  Words that over ``hot``
    rows have in a position are no one task's."""
    lines = stage(line_patterns(docs, depth), "lines")
    leaves = stage(lines.groupBy("leaf").agg(F.count("*").alias("d")).where(F.col("d") >= min_docs).select("leaf"), "leaves")
    # a leaf that the bitmap lets through in vain has no constant word, so no join need follow
    rows_of = split_by(lines.select("leaf", "pattern"), "leaf", leaves)[1].groupBy("pattern").agg(F.count("*").alias("d"))
    words = split_by(line_words(docs, depth), "leaf", leaves)[1].dropDuplicates(["pattern"])
    shapes = stage(words.join(rows_of, "pattern"), "shapes").withColumn("word", F.split(F.col("words").cast("string"), " ")).withColumn("n", F.size("word"))
    place = shapes.select("pattern", "leaf", "n", "d", F.posexplode("word").alias("at", "word")).where(F.col("word") != FIELD.decode())
    place = place.select("pattern", "n", "d", F.xxhash64("leaf", "at", "word").alias("h"))
    constant = stage(place.groupBy("h").agg(F.sum("d").alias("held")).where(F.col("held") >= min_docs), "constant")
    near = split_by(place.select("pattern", "n", "h"), "h", constant.select("h"))[1]
    marked = join_spread(near, constant, "h", constant.where(F.col("held") > hot).select("h")).where(F.col("held").isNotNull())
    marked = marked.groupBy("pattern").agg(F.max("n").alias("n"), F.count("*").alias("fixed"), F.bit_xor("h").alias("a"), F.bit_xor(F.xxhash64("h")).alias("b"))
    need = F.when(F.col("n") < short, F.col("n").cast("double")).otherwise(min_constant * F.col("n"))
    shaped = stage(marked.where(F.col("fixed") >= need).select("pattern", F.xxhash64("n", "fixed", "a", "b").alias("template")), "shaped")
    hits = split_by(lines.select("own", "pattern", "words", "whole"), "pattern", shaped.select("pattern"))[1]
    hits = hits.join(shaped, "pattern").groupBy("own", "pattern")
    hits = stage(hits.agg(*[F.max(c).alias(c) for c in ("words", "whole", "template")]), "hits")

    def recurring(rows: DataFrame) -> DataFrame:
        return rows.select("template", "own").distinct().groupBy("template").agg(F.count("*").alias("d")).where(F.col("d") >= min_docs).select("template")

    known = stage(hits.join(recurring(hits), "template", "left_semi"), "known")
    evidence = known.groupBy("own").agg(F.sum("words").alias("in"), F.max("whole").alias("whole")).where(F.col("in") < mostly * F.col("whole")).select("own")
    proven = recurring(known.join(evidence, "own", "left_semi"))
    return known.join(stage(proven, "proven"), "template", "left_semi").select("own", "pattern")


def drop_recurring_lines(docs: DataFrame, depth: int = 3, count: str | None = "n_dropped", **limits) -> DataFrame:
    """docs with the recurring lines taken out of text, and in the column ``count`` (which takes the place of one of that
    name; None for none) how many lines that were."""
    own, key, drop, cut = (unused(docs.columns, c) for c in ("own", "key", "drop", "cut"))

    @F.pandas_udf("struct<text:string,n:bigint>")
    def without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        rows = []
        for text, keys in zip(texts, drops):
            if text is None or keys is None:
                rows.append((None, 0))
                continue
            gone, lines = {int(k).to_bytes(8, "big", signed=True) for k in keys}, text.split("\n")
            kept = [x for x in lines if not (w := masked_words(x.encode("utf-8", "surrogatepass"))) or pattern(w) not in gone]
            rows.append(("\n".join(kept), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n"])

    lost = recurring_lines(docs, depth, **limits).groupBy(F.col("own").alias(key)).agg(F.collect_list("pattern").alias(drop))  # lines of one text
    lost = stage(lost, "lost")
    sure, rest = split_by(docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))), own, lost.select(key))
    # the list grows with the input, so it is never broadcast
    cleaned = rest.join(lost.hint("merge"), F.col(own) == F.col(key), "left").withColumn(cut, without("text", drop))
    hit = F.col(drop).isNotNull()
    kept = [c for c in docs.columns if c != count]
    with_count = lambda rows, n: rows.withColumn(count, n) if count else rows
    fixed = [F.when(hit, F.col(f"{cut}.text")).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in kept]
    plain = with_count(sure.select(*[F.col(f"`{c}`") for c in kept]), F.lit(0).cast("bigint"))
    return plain.unionByName(cleaned.select(*fixed, *([F.coalesce(f"{cut}.n", F.lit(0)).cast("bigint").alias(count)] if count else [])))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 on all documents."""
    return drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
