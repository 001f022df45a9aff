"""Connected components of links by alternating stars; every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.scratch import store


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of `links` (a, b), stored.

    The large star ties each node's larger neighbours to its smallest one, the small
    star its smaller neighbours. Both keep what is connected; depth falls fast,
    and once every node is tied to its component's smallest, nothing changes. No node's
    neighbours are gathered: a hub is a grouped minimum and a join that Spark splits.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = store(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = store(tied.select("e.*").where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    least = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return least.unionByName(least.select(F.col("component").alias("node"), "component").distinct())
