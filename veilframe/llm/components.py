"""Connected components over a table of links, without gathering any component in one task.

Every round hooks each node to its smallest neighbour, follows the new pointers four steps and contracts
the links. A node with a smaller neighbour always disappears, so the nodes halve at least. All group-bys
are minima (combined before the shuffle); all joins read written tables on both sides, so AQE can split
the partition of a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _follow(left: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Replace ``column`` by its parent where it has one."""
    p = parent.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
    return left.join(p, left[column] == p["_node"], "left").withColumn(column, F.coalesce("_up", column)).drop("_node", "_up")


def connected_components(work: Workspace, links: DataFrame, name: str = "cc") -> DataFrame:
    """links(src long, dst long) -> (node long, root long): a row per node that has a link to another; root is the smallest node reachable.

    Null ends and loops are left out; repeated links and either direction are fine; no links give no rows.
    """
    edges = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    edges = work.table(edges, f"{name}-edges0")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    labels = work.table(labels, f"{name}-labels0")
    step = 0
    while not edges.isEmpty():
        step += 1
        parent = work.table(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), f"{name}-hook{step}")
        for jump in range(2):
            parent = work.table(_follow(parent, "up", parent), f"{name}-jump{step}.{jump}")
        half = work.table(_follow(edges, "b", parent), f"{name}-half{step}")
        both = _follow(half, "a", parent).where("a <> b")
        edges = work.table(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges{step}")
        labels = work.table(_follow(labels, "root", parent), f"{name}-labels{step}")
        for used in (f"edges{step - 1}", f"labels{step - 1}", f"hook{step}", f"jump{step}.0", f"jump{step}.1", f"half{step}"):
            work.drop(f"{name}-{used}")
    return labels
