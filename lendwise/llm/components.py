"""Connected components of an edge list, by alternating large-star and small-star rounds.

Both star steps are a grouped minimum (pre-aggregated before the shuffle) joined back to the edges, so a
node with very many links is never gathered into one task's memory: the join may split its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them (edges run from larger to smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` → ``(node, component)`` for every node with a link; the component is its smallest node.

    Loops, repeated edges and either direction are allowed; rows with a null end are ignored. An empty list
    gives an empty result. Each round is written to the shared checkpoint folder, so no lineage piles up.
    Raises ``RuntimeError`` if ``max_rounds`` do not settle it (rounds needed grow with the logarithm of size).
    """
    current = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        mark = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == seen or mark[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        seen = mark
        current = written(_small_star(_large_star(current)), "edges")
    raise RuntimeError(f"connected components not settled after {max_rounds} rounds")
