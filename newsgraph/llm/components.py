"""Connected components of a large edge table: hook to the smallest neighbour, jump to the root, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.session import stored


def _roots(parents: DataFrame) -> DataFrame:
    """Replace every parent by its root. Chains halve with each jump, so n steps take log n rounds."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = stored(
            parents.join(up, "parent", "left").select(
                "node",
                F.coalesce("grand", "parent").alias("parent"),
                (F.coalesce("grand", "parent") != F.col("parent")).alias("_moved"),
            ),
            "roots",
        )
        parents = jumped.select("node", "parent")
        if jumped.where("_moved").isEmpty():
            return parents


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an undirected edge table; a component is named by its smallest node.

    Each round hooks every node to the smallest node next to it (a total per node, combined inside tasks, so a hub
    is no hot group), finds the roots, and keeps the edges between different roots. A node that has a smaller
    neighbour disappears, so the edge table shrinks geometrically. All state is in written tables; a lost executor
    costs the repetition of its tasks only. NULL ends and loops are ignored.
    """
    left = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    left = stored(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    names = stored(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    names = names.withColumn("component", F.col("node"))
    while not left.isEmpty():
        # The end b of an edge has the smaller neighbour a; a node that is never b is a local root.
        hooks = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        roots = stored(_roots(hooks), "hooks")
        names = stored(
            names.join(roots, names["component"] == roots["node"], "left").select(
                names["node"], F.coalesce("parent", "component").alias("component")
            ),
            "names",
        )
        for end in ("a", "b"):
            to = roots.select(F.col("node").alias(end), F.col("parent").alias("_root"))
            left = left.join(to, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
        left = left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = stored(left.distinct(), "edges")
    return names
