"""Connected components by contracting edges; every step is a join or an aggregation, nothing meets on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a task's part of a light table (two longs a row, 4 MB): what is left of the edges falls fast, and so does what is written.
LIGHT_ROWS = 1 << 18
#: The nodes that still have edges fall by a constant factor each round; this is far beyond any table.
MAX_ROUNDS = 64


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, component for each end of ``edges`` (a, b long), where component is the smallest node reachable.

    Each round points every node at the smallest of itself and its neighbours, follows these pointers
    once more, and keeps the edges between different targets. Smallest goes by a bijective hash of the
    nodes, so no order of theirs (a path of rising ids, say) makes the pointers creep. Hubs cost no more
    than their edges: minima are taken before the shuffle. Self-loops make a component of their own.
    """
    edges = scratch.write(edges.select("a", "b").distinct(), f"{name}-edges")
    parts = max(1, -(-2 * edges.count() // LIGHT_ROWS))
    write = lambda df, table: scratch.write(df.coalesce(parts), f"{name}-{table}")
    left = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    steps: list[DataFrame] = []
    for k in range(MAX_ROUNDS):
        both = left.union(left.select("b", "a")).toDF("node", "other")
        pointed = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to"))
        pointed = write(pointed, f"pointed{k}")
        up = pointed.toDF("to", "next")
        step = write(pointed.join(up, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"step{k}")
        steps.append(step)
        moved = left.join(step.toDF("a", "to_a"), "a").join(step.toDF("b", "to_b"), "b")
        left = write(moved.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), f"edges{k + 1}")
        parts = max(1, -(-2 * (n := left.count()) // LIGHT_ROWS))
        if not n:
            break
    else:
        raise RuntimeError("components did not settle")
    found = steps[0]
    for k, step in enumerate(steps[1:], 1):
        found = found.join(step.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        if k % 4 == 0:
            found = scratch.write(found, f"{name}-found{k}")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    named = scratch.write(nodes.join(found.select(F.col("node").alias("h"), "to"), F.xxhash64(nodes["node"]) == F.col("h")).select(nodes["node"], "to"), f"{name}-named")
    least = named.groupBy("to").agg(F.min("node").alias("component"))
    return named.join(least, "to").select("node", "component")
