"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facelake.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One pass over edges (u, v), u > v.

    The large star links every larger neighbour of a node to the smallest of its neighbourhood, the
    small star every smaller one and the node itself. Only minima are gathered, never neighbourhoods.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge: root is the smallest id of its component.

    edges: two long columns, in any direction, loops and repeats allowed. Each round is written to
    the shared folder. Raises if max_rounds do not suffice, which takes chains of about 2**30 nodes.
    """
    src, dst = (F.col(f"`{c}`") for c in edges.columns[:2])
    now = stored(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v").distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if total[0] == 0 or total == before:
            break
        before = total
        now = stored(_star(stored(_star(now, True), "edges"), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
