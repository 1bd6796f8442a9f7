"""Breadth-first depth over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.storage import materialize


def bfs_depth(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """``root, node, depth``: least depth of every node reachable within ``max_depth`` steps; cycles are safe.

    ``edges`` has ``src, dst``; ``roots`` has ``root``. One frontier a round, without nodes already seen;
    every round is written to shared storage, so the plan does not grow with the depth."""
    seen = materialize(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "bfs")
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        known = seen.select(F.col("root").alias("_r"), F.col("node").alias("_n"))
        fresh = step.join(known, (F.col("root") == F.col("_r")) & (F.col("node") == F.col("_n")), "left_anti")
        front = materialize(fresh.withColumn("depth", F.lit(depth)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
