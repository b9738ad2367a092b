"""Operator 4: hierarchical residual best-fit packing.

Every partition packs its items best-fit, longest first, and closes the bins that are nearly full.  The others, its
residual, go up a tree as items: groups of partitions meet, and each group packs its residual best-fit again, until one
group is left.  After its first merge a group hands up its bins that are at most half full and as many of the emptiest
others as the next merge could use, so a merge reads a bounded number of rows; the bins it does not hand up are closed
as they are.

Items of any size up to the capacity; null sizes count as 0; equal items are placed in their order of arrival; an empty
table packs into none.  Other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import read_table, stage
from barweave.llm.tokenise import CACHE, encoder, vocabulary_path

FAN = 8
HOSTS = 64


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its bin and its place there; for each bin its fill.  Longest first, into the fullest bin it fits."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills = 0, []  # rooms: bit r is set if some bin has room r
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            own, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = own, fills[own]
        fills[own] += size
        by_room[room - size].append(own)
        rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def pack(items: DataFrame, capacity: int, size: str = "length", near_full: float = 0.98) -> DataFrame:
    """items with sequence_id and offset; items are read again and again, so pass a table or a staged DataFrame."""
    names, full = items.columns, int(capacity * near_full)
    if clash := {"sequence_id", "offset", "bin", "own_offset", "fill"} & set(names):
        raise ValueError(f"rename the columns {sorted(clash)} first")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one partition's rows
        if not held:
            return
        table = pa.Table.from_batches(held)
        sizes = np.array([x or 0 for x in table.column(size).to_pylist()], np.int64)
        if len(sizes) and sizes.max() > capacity:
            raise ValueError(f"an item of {sizes.max()} is longer than {capacity}")
        bins, offsets, fills = best_fit(sizes, capacity)
        task = TaskContext.get().partitionId() << 40
        for name, column in (("bin", bins + task), ("own_offset", offsets), ("fill", fills[bins] if len(bins) else bins)):
            table = table.append_column(name, pa.array(column, pa.int64()))
        yield from table.to_batches(10_000)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    packed = stage(items.mapInArrow(local, f"{types}, bin bigint, own_offset bigint, fill bigint"), "packed")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bins, offsets, fills = best_fit(group["fill"].to_numpy(), capacity)
        roots = np.zeros(len(fills), np.int64)
        first = offsets == 0
        roots[bins[first]] = group["bin"].to_numpy()[first]
        half = np.flatnonzero(fills <= capacity // 2)
        host = np.flatnonzero((fills > capacity // 2) & (fills < full))
        up = np.zeros(len(fills), bool)
        up[half] = True
        up[host[np.argsort(fills[host], kind="stable")[:HOSTS]]] = True
        return pd.DataFrame({"grp": group["grp"], "bin": group["bin"], "root": roots[bins], "shift": offsets, "fill": fills[bins], "up": up[bins] & first})

    residual = packed.where((F.col("own_offset") == 0) & (F.col("fill") < full) & (F.col("fill") > 0)).select("bin", "fill", F.shiftright("bin", 40).alias("grp"))
    residual = stage(residual.dropDuplicates(["bin"]), "residual")
    moved = residual.select("bin", F.col("bin").alias("root"), F.lit(0).cast("bigint").alias("shift"))
    groups = residual.agg(F.max("grp")).first()[0]  # a number of partitions
    while groups is not None:
        groups //= FAN
        ups = residual.withColumn("grp", F.floor(F.col("grp") / FAN)).groupBy("grp").applyInPandas(merge, "grp bigint, bin bigint, root bigint, shift bigint, fill bigint, up boolean")
        ups = stage(ups, "merged")
        step = ups.select(F.col("bin").alias("root"), F.col("root").alias("next"), F.col("shift").alias("more"))
        moved = stage(
            moved.join(step, "root", "left").select("bin", F.coalesce("next", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")),
            "moved",
        )
        residual = ups.where("up").select("bin", "fill", "grp")
        groups = groups if groups else None
    sequence, place = F.coalesce("root", "bin"), F.col("own_offset") + F.coalesce("shift", F.lit(0))
    return packed.join(moved, "bin", "left").select(*[F.col(f"`{n}`") for n in names], sequence.alias("sequence_id"), place.alias("offset"))


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """The pieces of every document: its ids and end_id, whole or, if longer than capacity, in pieces of capacity ids of
    which the first takes what is left over.  with_ids adds the ids themselves.  cache: see tokenise.py."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, cache), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[list] = [[] for _ in range(6 if with_ids else 5)]
                for doc, raw in zip(part.column(0).to_pylist(), enc.batch(part.column(1).to_pylist())):
                    raw += end
                    edges = list(range(len(raw) // 4, 0, -capacity))[::-1]
                    for k, (i, j) in enumerate(zip([0, *edges], edges)):
                        own = raw[4 * i : 4 * j]
                        for column, value in zip(rows, (doc, k, i, j - i, zlib.crc32(own))):
                            column.append(value)
                        if with_ids:
                            rows[5].append(np.frombuffer(own, "<u4").astype(np.int32))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                columns = [pa.array(c, t) for c, t in zip(rows, kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The token ids of each sequence, from packed pieces with their ids; a sequence has at most capacity of them."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, cache: int = CACHE) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    A null text is an empty document, which is its end id alone; null and repeated ids are documents of their own.
    """
    return pack(stage(cut_documents(docs, vocabulary, end_id, capacity, cache=cache), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 on all documents."""
    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
