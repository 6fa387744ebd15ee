"""Connected components by alternating large-star and small-star rounds.

Every step is a partial aggregation (the least neighbour of each node) and an equi-join with it, so no task ever
holds the neighbours of one node together, and a hub with a third of all edges is split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), "src").alias("least"))
    return (
        both.where("dst > src").join(least, "src").where("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges point from larger to smaller."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    moved = edges.join(least, "src").where("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Map each node of an edge to the least node of its component.

    edges has two columns of one orderable type, src and dst. Edges with a null end and loops are ignored; repeated
    edges and either direction are fine. Returns (node, root), also for the root itself; no row for an empty input.
    """
    edges = (
        edges.where("src is not null and dst is not null and src != dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    edges, seen = scratch.write(edges, "edges"), None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen, before = state, edges
        edges = scratch.write(_small_star(_large_star(edges)), "edges")
        scratch.delete(before)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
