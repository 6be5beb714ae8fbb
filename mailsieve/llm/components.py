"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest reachable node of every node that reaches a smaller one. ``edges`` has columns a, b.

    Each round writes its edges to the shared folder; nothing but a count and a checksum reaches the driver.
    Loops and null ends are ignored; an empty input gives an empty result.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:  # every round makes edges point lower, so it ends
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = saved(small)
        after = mark(now)
        if after == before:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = after


def rerooted(named: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) anew after edges (a, b) between roots."""
    top = components(edges).select(F.col("node").alias("__was"), F.col("root").alias("__now"))
    return named.join(top, F.col("root") == F.col("__was"), "left").select("node", F.coalesce("__now", "root").alias("root"))
