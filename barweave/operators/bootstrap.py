"""Paired moving-block bootstrap of two return paths.

Start positions come from a seeded PCG64 generator, drawn inside the tasks, one row a replicate.  A replicate's path is
folded over slices of its symbol's array of returns (one price history), so nothing of size replicates x bars is ever
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(lengths: DataFrame, replicates: int, block: int, seed: int) -> DataFrame:
    """symbol, replicate and its block starts for each (symbol, n); a series shorter than a block is an error."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol, n in zip(batch["symbol"], batch["n"]):
                if n < block:
                    raise ValueError(f"{symbol}: {n} returns are fewer than a block of {block}")
                drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, n - block + 1, size=(replicates, -(-n // block)), dtype=np.int64)
                yield pd.DataFrame({"symbol": symbol, "replicate": np.arange(replicates), "starts": list(drawn)})

    return lengths.select("symbol", "n").mapInPandas(draw, "symbol string, replicate bigint, starts array<bigint>")


def _statistics(path: Column, field: str) -> Column:
    """Struct (net, drawdown) of the compounded path."""
    seed = F.struct(F.lit(1.0).alias("wealth"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("drawdown"))

    def step(z: Column, x: Column) -> Column:
        wealth = z["wealth"] * (1 + x[field])
        peak = F.greatest(z["peak"], wealth)
        return F.struct(wealth.alias("wealth"), peak.alias("peak"), F.greatest(z["drawdown"], (peak - wealth) / peak).alias("drawdown"))

    return F.aggregate(path, seed, step)


def block_bootstrap(returns: DataFrame, replicates: int = 1000, block: int = 42, seed: int = 1788) -> DataFrame:
    """For each symbol of returns (symbol, candle_index, candidate, baseline) the 5th, 50th and 95th percentile of the
    differences in net return, drawdown and return to drawdown (0 without a drawdown)."""
    series = returns.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("candle_index", "candidate", "baseline"))).alias("path"), F.count("*").alias("n"))
    drawn = starts(returns.groupBy("symbol").agg(F.count("*").alias("n")), replicates, block, seed)
    # few rows, so that the folds of one symbol's replicates do not stay in one task
    spread = drawn.repartition("symbol", "replicate").join(series, "symbol")
    picked = F.slice(F.flatten(F.transform("starts", lambda s: F.slice("path", (s + 1).cast("int"), block))), F.lit(1), F.col("n").cast("int"))
    paths = spread.select("symbol", "replicate", picked.alias("p"))
    told = paths.select("symbol", "replicate", _statistics(F.col("p"), "candidate").alias("c"), _statistics(F.col("p"), "baseline").alias("b"))
    net = lambda s: F.col(f"{s}.wealth") - 1
    ratio = lambda s: F.coalesce(net(s) / F.nullif(F.col(f"{s}.drawdown"), F.lit(0.0)), F.lit(0.0))
    diffs = {"net_return": net("c") - net("b"), "drawdown": F.col("c.drawdown") - F.col("b.drawdown"), "return_to_drawdown": ratio("c") - ratio("b")}
    quantiles = told.groupBy("symbol").agg(F.count("*").alias("replicates"), *[F.percentile(v, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias(k) for k, v in diffs.items()])
    return quantiles.select("symbol", "replicates", *[F.col(k)[i].alias(f"{k}_{p}") for k in diffs for i, p in enumerate(("p05", "median", "p95"))])
