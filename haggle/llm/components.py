"""Connected components by contraction: every node hooks to its least
neighbour, edges are renamed to the hooks, and the smaller graph goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.llm.spark import remove, written


def _hooks(edges: DataFrame) -> DataFrame:
    """(node, to): the least of a node and its neighbours."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    # a partial aggregate on each map task keeps a hub's neighbours apart
    return both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))


def _jumped(hooks: DataFrame) -> DataFrame:
    """Every hook followed once more."""
    again = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return hooks.join(again, "to").select("node", F.col("next").alias("to"))


def _renamed(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    a = hooks.select(F.col("node").alias("a"), F.col("to").alias("a2"))
    b = hooks.select(F.col("node").alias("b"), F.col("to").alias("b2"))
    new = edges.join(a, "a").join(b, "b").where("a2 <> b2")
    return new.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), a <> b; the
    component's name is its least node.  No edges give no rows.  The number of
    rounds is logarithmic in practice; nothing is collected.  Each round's tables
    are written to the shared folder, and removed when the next round has its own."""
    spark = edges.sparkSession
    edges, old_edges = written(edges.select("a", "b"), "edges")
    nodes, old_nodes = None, None
    while nodes is None or not edges.isEmpty():
        hooks, one = written(_hooks(edges), "hooks")
        hooks, two = written(_jumped(hooks), "hooks")
        if nodes is None:
            more = hooks.select("node", F.col("to").alias("component"))
        else:
            step = hooks.select(F.col("node").alias("component"), "to")
            more = nodes.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        nodes, new_nodes = written(more, "nodes")
        edges, new_edges = written(_renamed(edges, hooks), "edges")
        remove(spark, [one, two, old_edges, *([old_nodes] if old_nodes else [])])
        old_edges, old_nodes = new_edges, new_nodes
    remove(spark, [old_edges])
    return nodes
