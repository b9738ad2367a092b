"""Event schedules that never carry a position across a segment boundary or a gap of the decision index.

A decision says up (enter if flat), down (leave if long) or neither, and the first one after a boundary or a gap starts
flat.  So every decision maps {flat, long} either to one state whatever came before, or to itself; such maps compose to the
last one that sets a state.  A block of rows is summarised by its own composition, a window over the few summaries of a
series gives each block the state it starts in, and no window over rows is wider than a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.sources.shared import written


def next_boundary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, segment and boundary: the candle_index at which the next segment of a series starts, null after the last."""
    starts = rows.groupBy(*keys, "segment").agg(F.min("candle_index").alias("start"))
    return starts.select(*keys, "segment", F.lead("start").over(Window.partitionBy(*keys).orderBy("start")).alias("boundary"))


def neighbours(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """rows with block, last (the series' last index), and index and segment of the rows before and after."""
    rows = rows.withColumn("block", F.expr(f"candle_index div {block}"))
    at = F.struct("candle_index", "segment")
    ends = rows.groupBy(*keys, "block").agg(F.min(at).alias("first_row"), F.max(at).alias("last_row"))
    series = Window.partitionBy(*keys).orderBy("block")
    ends = ends.select(*keys, "block", F.lag("last_row").over(series).alias("left"), F.lead("first_row").over(series).alias("right"), F.max("last_row").over(Window.partitionBy(*keys))["candle_index"].alias("last"))
    inside = Window.partitionBy(*keys, "block").orderBy("candle_index")
    joined = rows.join(ends, [*keys, "block"])
    return joined.withColumn("prev", F.coalesce(F.lag(at).over(inside), "left")).withColumn("next", F.coalesce(F.lead(at).over(inside), "right")).drop("left", "right")


def held_states(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows of ``neighbours`` with before and held: the state that a decision meets and the one it leaves."""
    fresh = F.col("prev").isNull() | (F.col("prev.segment") != F.col("segment")) | (F.col("prev.candle_index") + 1 != F.col("candle_index"))
    rows = rows.withColumn("fresh", fresh).withColumn("sets", F.when(F.col("up"), True).when(F.col("down") | F.col("fresh"), False))
    # the state that a block's rows compose to; max of a struct takes the last row that sets one
    ends = rows.where(F.col("sets").isNotNull()).groupBy(*keys, "block").agg(F.max(F.struct("candle_index", "sets"))["sets"].alias("composed"))
    blocks = rows.select(*keys, "block").distinct().join(ends, [*keys, "block"], "left")
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "block", F.coalesce(F.last("composed", ignorenulls=True).over(earlier), F.lit(False)).alias("carried"))
    inside = Window.partitionBy(*keys, "block").orderBy("candle_index")
    rows = rows.join(blocks, [*keys, "block"]).withColumn("held", F.coalesce(F.last("sets", ignorenulls=True).over(inside), "carried"))
    return rows.withColumn("before", ~F.col("fresh") & F.coalesce(F.lag("held").over(inside), "carried"))


def boundary_safe_events(decisions: DataFrame, keys: list[str], latency: int = 0, block: int = 4096) -> DataFrame:
    """keys, candle_index, action (ENTER or EXIT) of decisions: keys, candle_index (unique in a series), segment, boundary
    (see next_boundary), up and down, of which a row has one at most; null is false.

    Orders fill on the next bar after ``latency`` more, so the last safe decision before a boundary is boundary - 2 -
    latency: later events go, a position held there is left there, and one entered there is not entered.  A position held
    at a gap inside a segment is left at the row before it, or not entered if that is the row.  A position held at the last
    row is left there.  A boundary that lies just after the last row counts if an order of that row would fill past it.
    """
    if isinstance(latency, bool) or latency < 0:
        raise ValueError("latency must be a whole number of bars, zero or more")
    true = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    rows = written(decisions.select(*keys, F.col("candle_index").cast("long"), F.col("segment").cast("long"), F.col("boundary").cast("long"), true("up"), true("down")), "decisions")
    rows = held_states(neighbours(rows, keys, block), keys)
    after = F.col("next.candle_index")
    leaves = F.coalesce(F.col("next.segment") != F.col("segment"), F.lit(True))
    rows = rows.withColumns({
        "safe": F.when(F.col("boundary") <= F.col("last") + 1 + latency, F.col("boundary") - 2 - latency),
        "enter": F.col("held") & ~F.col("before"),
        "gap": F.col("held") & ~leaves & (after != F.col("candle_index") + 1),
        "leaves": leaves,
    })
    i, safe = F.col("candle_index"), F.col("safe")
    rows = rows.withColumns({
        "kept": safe.isNull() | (i <= safe),
        "forced": F.coalesce(F.col("held") & ~F.col("gap") & (i <= safe) & (F.col("leaves") | (after > safe)), F.lit(False)),
        "final": F.col("held") & F.col("next").isNull() & safe.isNull(),
    })
    at_safe = F.col("forced") & (i == safe)
    own = F.when(F.col("kept") & F.col("enter") & ~F.col("gap") & ~at_safe & ~F.col("final"), "ENTER").when(
        F.col("kept") & ((F.col("before") & ~F.col("held")) | (F.col("gap") & ~F.col("enter")) | F.col("final")), "EXIT"
    )
    left = F.when(F.col("forced") & ~(F.col("enter") & at_safe), "EXIT")
    both = F.array(F.struct(i.alias("candle_index"), own.alias("action")), F.struct(safe.alias("candle_index"), left.alias("action")))
    return rows.select(*keys, F.explode(both).alias("e")).select(*keys, "e.candle_index", "e.action").where(F.col("action").isNotNull())
