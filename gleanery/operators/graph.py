"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node reaches; nodes without an edge to another are left out.

    Large-star and small-star steps (Kiveris et al. 2014) alternate until the edges
    stand still, which a checksum over them tells. Every step groups with partial
    aggregation and joins the minimum back, so a hub's edges aren't held together.
    Null ends and loops are ignored, ids may be of any type that has an order.
    """
    scratch = Scratch(edges.sparkSession)
    a, b = F.col(src), F.col(dst)
    e = scratch.write(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before == now or not now[0]:
            break
        before = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small)
        scratch.drop(large)
        scratch.drop(e)
        e = new
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
