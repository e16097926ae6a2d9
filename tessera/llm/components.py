"""Connected components of an undirected graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    tied = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b), but the roots themselves; root is the least node of the component.

    Each round is written to the shared folder; rounds go with the logarithm of the longest path. A node with very
    many edges is pre-aggregated where its rows are, and joined back by Spark's skew handling.
    """
    now = stored(edges.select("a", "b").filter("a != b").distinct())
    state = None
    while True:
        after = stored(_small_star(_large_star(now)))
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, state = after, tuple(seen)
