"""Connected components of an edge table by hooking and contraction: joins and grouping only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Pointer jumps of one job: paths of up to 2^JUMPS nodes become one step.
JUMPS = 3


def _roots(hooks: DataFrame) -> DataFrame:
    """Of hooks (node, parent), parents smaller or the node itself: each node with the root above it."""
    while True:
        up = lambda low, _: low.join(hooks.select(F.col("node").alias("parent"), F.col("parent").alias("next")), "parent").select("node", F.col("next").alias("parent"))
        hooks = materialise(reduce(up, range(JUMPS - 1), hooks), "hooks")
        above = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        if not hooks.join(above, "parent").where("next <> parent").limit(1).count():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b), each node with the smallest node it reaches: (node, component). Nulls and loops don't link.

    Each round hooks every node to its least neighbour, if that is smaller, follows the hooks to their roots, and
    contracts the graph to those: at most half of the nodes are left, and only edges between different roots. So all
    rounds together join about twice the edges. Each round is written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rounds: list[DataFrame] = []
    while True:
        edges = materialise(edges, "edges")
        if rounds and not edges.limit(1).count():
            break
        both = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")).unionByName(edges.groupBy(F.col("a").alias("node")).agg(F.min("a").alias("parent")))
        hooks = _roots(materialise(both.groupBy("node").agg(F.min("parent").alias("parent")), "hooks"))
        rounds.append(hooks)
        for side in "ab":
            edges = edges.join(hooks.select(F.col("node").alias(side), F.col("parent").alias(f"root_{side}")), side)
        edges = edges.where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
    found = rounds.pop()
    while rounds:  # back from the smallest graph to the whole one
        further = found.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        found = materialise(rounds.pop().join(further, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent")), "components")
    return found.select("node", F.col("parent").alias("component"))
