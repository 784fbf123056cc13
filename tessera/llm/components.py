"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, save


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) longs -> (id, component) for every id that has an edge; component is the smallest id reached.

    Each step sends an edge list through two aggregations with map-side combine and two joins. Minima are written before
    they are joined, so that both sides of a join come from plain shuffles and the skew-join rule can split a hot node.
    The number of steps grows with the logarithm of the graph's size. Self-loops and null ends are dropped. No
    edges give an empty table.
    """
    e = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select("u", "v", "m")
        nxt = save(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for x in (e, low, large, least):
            drop(x)
        e = nxt
        if now == mark or not now[0]:
            break
        mark = now
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
