"""Connected components of a graph given as links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join over the links; the links never grow beyond their first number plus
one per node, and a hot node's links are split by adaptive skew handling of the join, as no operator needs them
together. The number of steps grows with the logarithm of the longest path. It ends when the links are stars around the
smallest nodes, which one grouped sum tells exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v with u <> v, one row per link. Large: to each larger neighbour its node's minimum; small: from each
    node's smaller neighbours to their minimum."""
    pairs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("m_u"), F.least("u", "m").alias("m"))
    joined = pairs.join(low, pairs["u"] == low["m_u"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("m_u").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _is_done(links: DataFrame) -> bool:
    """Whether every node has one link to its component's smallest node, which has none itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    open_ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up = 1 and low = 1)")
    return not open_ends.head(1)


def connected_components(links: DataFrame, what: str = "components") -> DataFrame:
    """node and component (its smallest node) for every node that has a link. links: u, v."""
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), what)
    while not _is_done(now):
        now = cut(_star(_star(now, True), False), what)
    # every link is now (node, smallest node)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
