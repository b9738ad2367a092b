"""Operator 1: mixing overlapping sources to target weights by min-cost flow.

Documents with the same set of sources form a pattern.  Words flow from patterns to the sources' quotas; the first copy
of a pattern's words costs nothing and each further copy more than the last, so the cheapest flow repeats as little and
as evenly as the quotas allow.  The network has a node for each pattern and source, never for a document, and is solved
on the driver.

A pattern's flow is full copies of all its documents and a rest, which a seeded order fills: documents by hash, up to
the hash at which the rest is reached, and then, up to ``FILLS`` times, the largest untaken document that still fits.
That hash is found digit by digit, from sums by pattern and digit of the documents at the digits so far, of which each
round leaves one in 4096.  Which documents are taken depends on seed, id and size alone, so the plan is a row for each
pattern, every document decides by itself, and no text or document is exchanged.

Null text has no words and is never taken; a null source is a source of its own, last in order; rows alike in id, text
and source share their fate, repeated ids otherwise do not; an empty table gives an empty result.  Other columns pass
through ``mix_documents``, whatever their names.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.llm.common import WORD, read_table, stage, unused

#: The plan is broadcast up to so many patterns, and joined beyond.
BROADCAST_PATTERNS = 100_000
FILLS = 3
DIGITS, BITS = 3, 12  # of the hashes


def quotas(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Each source's target: its weight's share of share * all sizes, at most cap * its size; the excess of capped
    sources is dealt again by weight.  Sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, out = list(order), share * sum(sizes.values()), {}
    while left:
        all_weight = sum(weight[s] for s in left)
        over = [s for s in left if total * weight[s] / all_weight > cap * sizes[s]]
        if not over:
            return out | {s: total * weight[s] / all_weight for s in left}
        for s in over:
            out[s] = cap * sizes[s]
        total -= sum(out[s] for s in over)
        left = [s for s in left if s not in out]
    return out


def min_cost_flow(supply: dict[tuple, int], demand: dict, copies: int = 2) -> dict[tuple[tuple, object], int]:
    """Words from each pattern to each of its sources.  supply: size of each pattern (a tuple of sources); demand: words
    each source asks for.  The k-th copy of a pattern costs k - 1 a word.

    Cheapest paths come in the order of their copies, so each further copy is opened in turn and the flow raised as far
    as it goes, by blocking flows over shortest paths."""
    patterns, sources = list(supply), list(demand)
    start, end = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    place = {s: len(patterns) + i for i, s in enumerate(sources)}
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(end + 1)]

    def add(u: int, v: int, most: float) -> int:
        at[u].append(len(to))
        at[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((most, 0))
        return len(to) - 2

    opened = [add(start, i, 0) for i in range(len(patterns))]
    own = {(p, s): add(i, place[s], float("inf")) for i, p in enumerate(patterns) for s in dict.fromkeys(p) if s in place}
    for s in sources:
        add(place[s], end, int(demand[s]))
    for _ in range(copies):
        for e, p in zip(opened, patterns):
            room[e] += supply[p]
        while True:
            level, queue = [-1] * (end + 1), deque([start])
            level[start] = 0
            while queue:
                u = queue.popleft()
                for e in at[u]:
                    if room[e] > 0 and level[to[e]] < 0:
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if level[end] < 0:
                break
            tried, path = [0] * (end + 1), []
            while True:
                u = to[path[-1]] if path else start
                if u == end:
                    push = min(room[e] for e in path)
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    path = path[: next(i for i, e in enumerate(path) if room[e] == 0)]
                    continue
                step = next((k for k in range(tried[u], len(at[u])) if room[at[u][k]] > 0 and level[to[at[u][k]]] == level[u] + 1), None)
                if step is not None:
                    tried[u] = step
                    path.append(at[u][step])
                elif path:
                    tried[to[path.pop() ^ 1]] += 1
                else:
                    break
    return {k: room[e ^ 1] for k, e in own.items()}


def _fill(rows: DataFrame) -> DataFrame:
    """pattern, upto (a hash) and open (words): of rows (pattern, size, h, rest) those below upto fill each pattern's rest
    but for open.  Rows with equal hashes are taken together."""
    before = Window.partitionBy("pattern").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    left = rows.withColumn("need", F.col("rest"))
    for k in range(DIGITS + 1):
        # 4096 digits a pattern at most; last the hashes themselves, of the few rows that agree in all digits
        digit = F.pmod(F.shiftright("h", 63 - BITS * (k + 1)), F.lit(1 << BITS)) if k < DIGITS else F.col("h")
        sums = left.groupBy("pattern", digit.alias("c")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
        runs = sums.withColumn("sum", F.coalesce(F.sum("words").over(before), F.lit(0)))
        hit = runs.where((F.col("sum") <= F.col("need")) & (F.col("sum") + F.col("words") > F.col("need")))
        hit = stage(hit.select("pattern", F.col("c").alias("digit"), (F.col("need") - F.col("sum")).alias("now")), "border")
        if k < DIGITS:
            inside = left.drop("need").join(F.broadcast(hit) if _few(hit) else hit, "pattern").where(digit == F.col("digit"))
            left = stage(inside.select(*rows.columns, F.col("now").alias("need")), "inside")
    return hit.select("pattern", F.col("digit").alias("upto"), F.col("now").alias("open"))


def _few(table: DataFrame) -> bool:
    return table.count() <= BROADCAST_PATTERNS


def mix(sized: DataFrame, demand: dict, copies: int = 2, seed: int = 42) -> DataFrame:
    """pattern, full, upto and extra: how often the mix takes the documents of sized (h: what names a row, sources:
    array<string>, size), for ``copies_of``.  demand: words each source asks for; null is a source."""
    spark = sized.sparkSession
    tagged = sized.where("size > 0").select(_pattern().alias("pattern"), _hash(seed).alias("h"), "size")
    totals = tagged.groupBy("pattern").agg(F.sum("size").alias("words")).collect()  # one row a pattern, as the flow needs
    tag = {s: "-" if s is None else "s" + s for s in demand}
    flow = min_cost_flow({tuple(r["pattern"]): r["words"] for r in totals}, {tag[s]: w for s, w in demand.items()}, copies)
    sums: dict[tuple, int] = {}
    for (p, _), words in flow.items():
        sums[p] = sums.get(p, 0) + int(words)
    plan = [(list(r["pattern"]), *map(int, divmod(sums.get(tuple(r["pattern"]), 0), r["words"]))) for r in totals]
    few = len(plan) <= BROADCAST_PATTERNS
    planned = stage(spark.createDataFrame(plan, "pattern array<string>, full long, rest long"), "plan")
    known = lambda table: F.broadcast(table) if few else table  # noqa: E731  one row a pattern
    rest = tagged.join(known(planned.where("rest > 0").select("pattern", "rest")), "pattern")
    border = stage(_fill(rest), "upto")
    full = planned.join(border, "pattern", "left").select("pattern", "full", "rest", "upto", F.coalesce("open", F.lit(0)).alias("open"), F.array().cast("array<bigint>").alias("extra"))
    for _ in range(FILLS):  # the largest untaken document of each pattern that still fits
        full = stage(full, "fill")
        behind = rest.select("pattern", "h", "size").join(known(full.select("pattern", "upto", "open", "extra").where("open > 0")), "pattern")
        behind = behind.where((F.col("h") >= F.col("upto")) & ~F.array_contains("extra", F.col("h")) & (F.col("size") <= F.col("open")))
        alone = behind.groupBy("pattern", "h").agg(F.sum("size").alias("words"), F.first("open").alias("most")).where("words <= most")
        best = alone.groupBy("pattern").agg(F.max(F.struct("words", "h")).alias("b"))
        full = full.join(best, "pattern", "left").select(
            "pattern", "full", "rest", "upto", (F.col("open") - F.coalesce("b.words", F.lit(0))).alias("open"), F.when(F.col("b").isNotNull(), F.concat("extra", F.array("b.h"))).otherwise(F.col("extra")).alias("extra")
        )
    full = stage(full, "fill").select("pattern", "full", "upto", "extra")
    return F.broadcast(full) if few else full


def _pattern() -> Column:
    return F.array_sort(F.array_distinct(F.transform("sources", lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("-")))))


def _hash(seed: int) -> Column:
    """Spreads evenly over the longs from 0."""
    return F.shiftrightunsigned(F.xxhash64("row", "size", F.lit(seed)), 1)


def copies_of(rows: DataFrame, plan: DataFrame, seed: int = 42, name: str = "copies") -> DataFrame:
    """rows (row, sources, size and others) with the number of copies that the plan takes, by each row alone."""
    pattern, full, upto, extra = (unused(rows.columns, c) for c in ("pattern", "full", "upto", "extra"))
    told = rows.withColumn(pattern, _pattern()).join(plan.toDF(pattern, full, upto, extra), pattern, "left")
    more = (_hash(seed) < F.col(upto)) | F.array_contains(extra, _hash(seed))
    number = F.when(F.col("size") > 0, F.coalesce(full, F.lit(0)) + F.coalesce(more, F.lit(False)).cast("long")).otherwise(F.lit(0))
    return told.withColumn(name, number.cast("long")).drop(pattern, full, upto, extra)


def _row_number() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1).cast("bigint")), F.coalesce("source", F.lit("\0")), F.xxhash64("text"))


def _size() -> Column:
    return F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint")


def sized_documents(docs: DataFrame) -> DataFrame:
    """row, sources and size of every row; rows alike in id, text and source share a row number, and so their fate."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _row_number().alias("row"), F.array("source").alias("sources"), "source", _size().alias("size"))


def _source_plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan, and source, source_size and target of each source."""
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # one row a source
    targets = quotas(sizes)
    told = sized.sparkSession.createDataFrame([(s, sizes[s], float(t)) for s, t in targets.items()], "src string, source_size long, target double")
    return mix(sized, targets), F.broadcast(told) if len(sizes) <= BROADCAST_PATTERNS else told


def mixed(docs: DataFrame) -> DataFrame:
    """row, doc_id, size, source_size, target and taken of every row of docs."""
    sized = stage(sized_documents(docs), "sized")
    plan, told = _source_plan(sized)
    out = copies_of(sized, plan)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return out.join(told, out["source"].eqNullSafe(told["src"]), "left").select("row", "doc_id", "size", "source_size", "target", taken)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them; each row decides by itself, so no text is exchanged."""
    sized = stage(sized_documents(docs), "sized")
    plan = _source_plan(sized)[0]
    own = unused(docs.columns, "own")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), _row_number().alias("row"), F.array("source").alias("sources"), _size().alias("size"))
    often = copies_of(held, plan).where("copies > 0")
    repeated = often.select(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("turn"))
    return repeated.select(*[F.col(f"{own}.`{c}`").alias(c) for c in docs.columns])


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 on all documents."""
    return mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
