"""Connected components of an edge table by alternating large-star and small-star steps.

Each step only needs the smallest neighbour of a node, which is pre-aggregated;
hubs are spread by Spark's skew join. The edge table is settled after each step,
so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import forget, settle


def _smallest(edges: DataFrame) -> DataFrame:
    return settle(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "cc-smallest")


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node that has an edge (a, b) to another; component is the smallest node."""
    now = settle(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "cc-edges",
    )
    before = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if seen.n == 0 or seen == before:
            break
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _smallest(both)
        large = both.where("v > u").join(least, both.u == least.w).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        roots = now.select("u").distinct().join(least, F.col("u") == least.w).where("m < u").select("u", F.col("m").alias("v"))
        old, now = (now, least), settle(large.unionByName(roots).where("u != v").distinct(), "cc-large")
        forget(*old)
        least = _smallest(now)
        small = now.join(least, now.u == least.w)
        moved = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
        old, now = (now, least), settle(moved.unionByName(kept).distinct(), "cc-small")
        forget(*old)
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = settle(stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "cc-stars")
    forget(now)
    return out
