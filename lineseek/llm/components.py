"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.runtime import materialize, release


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return (node, component), component the smallest node reachable, for every node with an edge.

    Each turn ties every node to the smallest node near it, until all edges lie in stars.
    Turns grow with the logarithm of the longest chain; every turn's edges are stored, and
    they never get more. Loops and repeated edges are ignored.
    """
    ends = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    current = materialize(ends)
    summary = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours move to the smallest of the neighbourhood.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Then smaller neighbours and the node itself do.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("a"), "m").where("a <> m")
        small = small.select(F.col("a").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        before, current = current, materialize(small.distinct())
        release(before)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == summary:
            break
        summary = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
