"""Connected components by hooking and pointer jumping, with aggregates and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.plans.storage import written


def _followed(parents: DataFrame, name: str) -> DataFrame:
    """(node, root): each node's parent, the parent's parent and so on up to the root."""
    current = written(parents, name)
    while True:
        up = current.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        step = current.join(up, current["root"] == up["__node"], "left")
        current = written(step.select("node", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")), name)
        if current.where("moved").isEmpty():
            return current.drop("moved")


def moved(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """df with column's nodes replaced by their roots; nodes that roots lacks stay."""
    to = roots.select(F.col("node").alias("__from"), F.col("root").alias("__to"))
    return df.join(to, df[column] == to["__from"], "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def roots_of(edges: DataFrame, name: str = "roots", forest: bool = False) -> DataFrame:
    """(node, root) of every node that reaches a smaller one; root: the smallest that it reaches.

    edges: columns a < b, distinct. Each node hooks to its smallest smaller neighbour, chains are shortened to their
    roots, and edges between different roots go on as the next, smaller graph until there are none. forest: no b has
    two edges, so that one turn does. Each step's table is written to the shared folder; a node with very many edges
    is a key of joins that Spark can split, and is aggregated before it moves.
    """
    found = None
    while True:
        hooks = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        if not forest:
            hooks = hooks.groupBy("node").agg(F.min("root").alias("root"))
        roots = _followed(hooks, name)
        found = roots if found is None else moved(found, "root", roots).unionByName(roots)
        if forest:
            return found
        left = moved(moved(edges, "a", roots), "b", roots).where("a != b")
        edges = written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        if edges.isEmpty():
            return found


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node that has an edge; component: the smallest node that can be reached.

    edges: columns a and b of one orderable type, in any direction, repeated or not; edges of a node to itself and edges
    with a null count for nothing.
    """
    clean = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = written(roots_of(written(clean, name), name), name)
    return found.select("node", F.col("root").alias("component")).unionAll(found.select("root", "root").distinct())
