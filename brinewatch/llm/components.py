"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the edge table, so no group, link list or component is
gathered anywhere; the number of steps grows with the logarithm of the longest chain. Every step is
written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewatch.session import checkpointed


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each ``u`` on the least of them; ``both`` has (u, v)."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node at most, on which nothing but leaves hangs."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counted = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for all nodes of ``edges`` but each component's least, which names it.

    A null end or a loop is no edge; repeated edges count once; no edges give no rows.
    """
    edges = checkpointed(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("u <> v")
        .distinct()
    )
    while not _is_star_forest(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, large=True)
        edges = checkpointed(
            _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), large=False)
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
