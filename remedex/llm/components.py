"""Connected components of an edge table, by hooking to smaller neighbours and contracting.

In each round every node hooks to its least neighbour if that is smaller, the hooks are followed twice more, and the
edges are rewritten to the new names.  Minima are aggregated before the shuffle, so a hub costs one row per task.  Each
round is written to the shared folder; the rounds end when no edge is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remedex.llm.common import Scratch


def _follow(names: DataFrame, hooks: DataFrame) -> DataFrame:
    """names (node, to) with ``to`` replaced by what it hooks to."""
    h = hooks.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
    return names.join(h, names["to"] == h["_n"], "left").select("node", F.coalesce("_t", "to").alias("to"))


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component (its least node) for every node of the edges (a, b)."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = scratch.put(edges, f"{name}-e0")
    names, k = None, 0
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        hooks = scratch.put(hooks, f"{name}-h{k}")
        hooks = scratch.put(_follow(_follow(hooks, hooks), hooks), f"{name}-j{k}")
        to_a = hooks.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        to_b = hooks.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        old = edges
        edges = old.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        edges = edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        edges = scratch.put(edges, f"{name}-e{k + 1}")
        names = hooks if names is None else scratch.put(_follow(names, hooks).unionByName(hooks.join(names, "node", "left_anti")), f"{name}-n{k}")
        k += 1
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    roots = names.select(F.col("to").alias("node"), F.col("to")).distinct().join(names, "node", "left_anti")
    return scratch.put(names.unionByName(roots).select("node", F.col("to").alias("component")), f"{name}-out")
