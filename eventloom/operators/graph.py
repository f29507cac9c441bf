"""The directly-follows graph as a table of edges (src, dst, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.eventlog import EventLog, to_event_log
from eventloom.schema import in_order


def frequency(log: DataFrame | EventLog) -> DataFrame:
    """src, dst, n: how often activity dst follows src at once in a case."""
    after = F.lead(F.struct("activity")).over(in_order())
    pairs = to_event_log(log).select(F.col("activity").alias("src"), after.alias("after")).where("after IS NOT NULL")
    return pairs.select("src", F.col("after.activity").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def frequency_of_traces(traces: DataFrame, trace: str = "trace") -> DataFrame:
    """The same from a column of arrays of states."""
    t = F.col(trace)
    pairs = F.when(F.size(t) > 1, F.arrays_zip(F.slice(t, 1, F.size(t) - 1).alias("src"), F.slice(t, 2, F.size(t) - 1).alias("dst")))
    return traces.select(F.explode(pairs).alias("p")).select("p.src", "p.dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()


def node_degree(edges: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """node, in_degree, out_degree, weighted. states: a table of all nodes (node); by default those of the edges."""
    sides = edges.select(F.col("dst").alias("node"), F.col("n").alias("i"), F.lit(0).cast("long").alias("o"))
    sides = sides.unionAll(edges.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("i"), F.col("n").alias("o")))
    if states is not None:
        sides = sides.unionAll(states.select("node", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("o")))
    return sides.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def density(edges: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """One row, density: the sum of weights over n (n - 1); over 1 where edges weigh more. Null with one node."""
    n = F.lit(n_nodes) if n_nodes is not None else F.col("k")
    size = nodes(edges).agg(F.count(F.lit(1)).alias("k"))
    total = edges.agg(F.sum("n").alias("w")).crossJoin(F.broadcast(size))
    return total.select(F.when(n > 1, F.col("w") / (n * (n - 1))).alias("density"))


def nodes_in_cycles(edges: DataFrame, max_cycle_length: int) -> DataFrame:
    """node, in_cycle: whether a walk of 2 ... max_cycle_length steps leads from the node to itself."""
    steps = edges.where("n > 0").select("src", "dst").distinct()
    reach, found = steps.select(F.col("src").alias("origin"), F.col("dst").alias("at")), None
    for _ in range(2, max_cycle_length + 1):
        reach = reach.join(steps, F.col("at") == F.col("src")).select("origin", F.col("dst").alias("at")).distinct()
        back = reach.where("origin = at").select(F.col("origin").alias("node"))
        found = back if found is None else found.unionAll(back)
    every = nodes(edges)
    if found is None:
        return every.withColumn("in_cycle", F.lit(False))
    return every.join(found.distinct().withColumn("hit", F.lit(True)), "node", "left").select("node", F.coalesce("hit", F.lit(False)).alias("in_cycle"))
