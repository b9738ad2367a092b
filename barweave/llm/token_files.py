"""Operator 10: token ids in fixed-width bit packing, in ascending document order.

A token store is a folder with two Parquet tables, written by Spark's committers so that a lost executor leaves no
half-written file and any store that Spark reaches can hold it:

* ``blocks``: one row a block of whole documents.  ``packed`` holds the block's ids, each in ``bits`` bits, the
  minimum for the vocabulary, least significant bit first; ``first`` is the place of its first id in its shard,
  ``doc_id`` and ``sizes`` list its documents.
* ``shards``: for each shard the number of ids before it and in it.

``read_documents`` unpacks with numpy; ``read_ids`` reads any range of ids and opens only the blocks that hold it.

Null text encodes as empty, null ids of documents come first, rows that share an id keep an order by content, an empty
table gives an empty store.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.llm.common import fresh_path, read_table
from barweave.llm.tokenise import encoder, vocabulary_path

BLOCKS = "shard int, block int, first long, n_ids long, bits int, doc_id array<bigint>, sizes array<int>, packed binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, each in that many bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype("<u4")[:, None] >> np.arange(bits, dtype="u4")) & 1, bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids from start to stop, without reading what lies before them."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", stop - start, start * bits // 8).astype("<u4")
    low, high = start * bits // 8, -(-stop * bits // 8)
    flat = np.unpackbits(np.frombuffer(packed, np.uint8, high - low, low), bitorder="little")
    skip = start * bits - 8 * low
    flat = flat[skip : skip + (stop - start) * bits].reshape(-1, bits)
    return (flat.astype("u4") << np.arange(bits, dtype="u4")).sum(1, dtype="u4").astype("<u4")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, block_ids: int = 1 << 17) -> None:
    """Encodes every text of docs (doc_id, text), appends end_id to each and writes the store at path."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / shards for i in range(1, shards)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, steps)), 100 * shards).alias("at")).first()
    bounds = np.array(sorted(set(found["at"] or [])), np.int64)  # one number a shard

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        bits = max(enc.size - 1, end_id).bit_length()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(0)
                known = np.array([-(2**63) if i is None else i for i in ids.to_pylist()], np.int64)
                raw = [np.append(np.frombuffer(b, "<u4"), np.uint32(end_id)) for b in enc.batch(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(bounds, known, "right"), pa.int32()), ids, pa.array([len(x) for x in raw], pa.int32()), pa.array([pack(x, bits) for x in raw], pa.binary())],
                    ["shard", "doc_id", "size", "ids"],
                )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = max(encoder(vocabulary).size - 1, end_id).bit_length()
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("packed", pa.binary())])
        shard, number, first, held, size = -1, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([unpack(raw, bits, 0, n) for _, n, raw in held])
            row = {"shard": shard, "block": number, "first": first, "n_ids": len(ids), "bits": bits, "doc_id": [d for d, _, _ in held], "sizes": [n for _, n, _ in held], "packed": pack(ids, bits)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for s, doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (s != shard or size >= block_ids):
                    yield close()
                    number, first = number + 1, first + size
                    held, size = [], 0
                if s != shard:
                    shard, number, first = s, 0, 0
                held.append((doc, n, raw))
                size += n
        if held:
            yield close()

    coded = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, "shard int, doc_id bigint, size int, ids binary")
    dealt = coded.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    dealt.mapInArrow(block, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    sizes.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids").coalesce(1).write.parquet(f"{path}/shards")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    blocks, shards = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/shards")
    # one row a shard, as many as shuffle partitions at the time of writing
    return blocks.join(F.broadcast(shards.select("shard", "start")), "shard").withColumn("first", F.col("start") + F.col("first"))


def read_documents(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and the ids, or with digest their crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["packed"], row["bits"], 0, row["n_ids"])
                at = np.concatenate(([0], np.cumsum(row["sizes"], dtype=np.int64)))
                if digest:
                    last = pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at, at[1:])], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_id"], pa.int64()), pa.array(row["first"] + at[:-1], pa.int64()), pa.array(row["sizes"], pa.int64()), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    placed = _placed(spark, path).select("first", "n_ids", "bits", "doc_id", "sizes", "packed")
    return placed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<int>"))


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """The ids at the places from start to stop of the whole store, which the caller can hold."""
    hit = _placed(spark, path).where((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start))
    parts = [np.zeros(0, "<u4")]
    for row in hit.select("first", "n_ids", "bits", "packed").orderBy("first").toLocalIterator():
        low, high = max(start, row["first"]), min(stop, row["first"] + row["n_ids"])
        parts.append(unpack(bytes(row["packed"]), row["bits"], low - row["first"], high - row["first"]))
    return np.concatenate(parts)


def op10_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 on all documents: the store is written, then read back."""
    path = fresh_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"), 2)
    return read_documents(spark, path, digest=True)
