"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a join and an aggregation over the edges, cut by a checkpoint; the number of edges never grows, and the driver
sees one row of sums for each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, m): the least of u's neighbours and u itself."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    hang = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hang.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Loops, repeated edges and nulls in the edges do no harm (edges with a null are no edges). It converges in a number of steps that
    is logarithmic in the longest path; ``most`` only guards against a fault, and raises.
    """
    now = checkpointed(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()

    before = state(now)
    for _ in range(most):
        if not before[0]:
            break
        now = checkpointed(_small_star(_large_star(now)))
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
