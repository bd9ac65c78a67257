"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum and a join, so no vertex's edges meet in one task; each round
is written to the shared folder and read back, which cuts lineage. Rounds grow with the
logarithm of the longest path. Null ends and loops are dropped; repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelens.llm.common import merged, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every vertex with an edge, the smallest vertex it reaches."""
    u, v = F.col(f"`{a}`").cast("long"), F.col(f"`{b}`").cast("long")
    now = stored(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = merged(both, low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(low).distinct(), "edges")
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
