"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum and a join, so no node's neighbours are ever gathered in one place; Spark's adaptive
skew handling splits the join of a hub. The loop ends when a step leaves the edges as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.materialize import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    # One row for each edge, so repeats are no more than the edges; the small star drops them.
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of ids that can be ordered, to ``(node, component)``; component is the smallest id reachable.

    Nulls and self loops are dropped, repeated and reversed edges count once, and an empty table gives an empty one.
    Only nodes with an edge appear. Raises if ``max_rounds`` isn't enough (rounds grow with the log of the diameter).
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = materialize(now, "edges")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return leaves.union(roots)
        seen = state
        now = materialize(_small_star(_large_star(now)), "stars")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
