"""Connected components of a graph of long ids, by alternating large and small stars.

Each round joins and groups by node with map-side combining and is written to the shared folder, so no list of
neighbours is ever built and a lost executor repeats one round at most.  The number of rounds grows with the logarithm
of the longest path; a round is followed by one grouping that tells whether the links are stars, and links that are stars
from the start take no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours, itself among the latter, to its least neighbour."""
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where(F.col("u") != F.col("v"))
    return out if large else out.distinct()  # repeats are combined before the next exchange


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is linked to one less node that is itself linked to none less."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))
    nodes = edges.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.sum("end.below").alias("below"), F.count("*").alias("n"))
    return nodes.where("below > 0 and n > 1").count() == 0


def stars(edges: DataFrame) -> DataFrame:
    """u, v: the components of edges (u, v) as links of each node but the least to the least."""
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stage(now.distinct(), "edges")
    while not _are_stars(now):
        now = stage(_star(_star(now, True), False), "stars")
    return now


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node that has an edge; edges: u, v (long)."""
    return rooted(stars(edges))


def rooted(links: DataFrame) -> DataFrame:
    """node and root of every node in links, which are stars."""
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
