"""The best simple paths of up to four edges from a seed to many targets, searched from both sides.

A front of up to two edges goes forward from the seed, and one of up to two edges backward from the targets; they meet in the
middle.  Of the front pieces that end in one node (and of the back pieces of one target and node) only those stay that can be part of
one of the best paths, so a hub hands on a fixed number of pieces, not one for each way into it.

Paths are ranked by edges, then by their weakest confidence, then by nodes.  The weakest confidence of a path is that of one
of its pieces, so pieces of a node rank by nodes within each confidence that occurs: ``most`` of them are enough, and two
more, as a path may not use a node twice and the two nodes beyond the middle can each strike out one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_confidence(edges: DataFrame, registry: dict[str, float]) -> DataFrame:
    """Edges (src, dst, relation) with the confidence of their relation; 0 for unknown ones."""
    m = F.create_map(*[F.lit(x) for kv in registry.items() for x in kv])
    return edges.select("src", "dst", "relation", F.coalesce(F.element_at(m, F.col("relation")), F.lit(0.0)).alias("weakest"))


def _thinned(pieces: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first pieces by nodes for each end and confidence."""
    order = W.partitionBy(*by, "weakest").orderBy("nodes")
    return pieces.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most + 2).drop("_n")


def front(edges: DataFrame, seed: str, allowed, steps: int, most: int) -> DataFrame:
    """at, nodes, relations, weakest: pieces of ``steps`` edges from the seed to nodes that may be within a path."""
    out = edges.where((F.col("src") == seed) & (F.col("dst") != seed) & allowed(F.col("dst")))
    out = out.select(F.col("dst").alias("at"), F.array("src", "dst").alias("nodes"), F.array("relation").alias("relations"), "weakest")
    for _ in range(steps - 1):
        e = edges.where(allowed(F.col("dst"))).select(F.col("src").alias("at"), "dst", "relation", F.col("weakest").alias("_w"))
        met = out.join(e, "at").where(~F.array_contains("nodes", F.col("dst")))
        met = met.select(F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), F.least("weakest", "_w").alias("weakest"))
        out = _thinned(met, ["at"], most)
    return out


def back(edges: DataFrame, targets: DataFrame, seed: str, allowed, steps: int, most: int, reached: DataFrame | None = None) -> DataFrame:
    """at, target, rest (the nodes after ``at``), more (their relations), weakest: pieces that end in the targets (id)."""
    goal = targets.select(F.col("id").alias("dst")).where(F.col("dst") != seed).distinct()
    e = edges.where(F.col("src") != seed)
    out = e.join(goal, "dst", "left_semi").where(allowed(F.col("src")))
    out = out.select(F.col("src").alias("at"), F.col("dst").alias("target"), F.array("dst").alias("rest"), F.array("relation").alias("more"), "weakest")
    for _ in range(steps - 1):
        into = e.where(allowed(F.col("src"))) if reached is None else e.join(reached.select(F.col("at").alias("src")).distinct(), "src", "left_semi")
        into = into.select(F.col("dst").alias("at"), "src", "relation", F.col("weakest").alias("_w"))
        met = out.join(into, "at").where((F.col("src") != F.col("target")) & ~F.array_contains("rest", F.col("src")))
        met = met.select(F.col("src").alias("at"), "target", F.concat(F.array("at"), F.col("rest")).alias("nodes"), F.concat(F.array("relation"), F.col("more")).alias("more"), F.least("weakest", "_w").alias("weakest"))
        out = _thinned(met, ["target", "at"], most).withColumnRenamed("nodes", "rest")
    return out


def best_paths(edges: DataFrame, seed: str, targets: DataFrame, allowed, registry: dict[str, float], hops: int = 3, most: int = 5) -> DataFrame:
    """target, nodes, relations, hops, min_confidence, rank of the best simple paths of each target (id).

    ``allowed`` says whether an id may be within a path. Targets with enough shorter paths are not searched further.
    """
    if not 1 <= hops <= 4:
        raise ValueError("paths have one to four edges")
    e = with_confidence(edges, registry)
    goal = targets.select("id").distinct()
    found = e.where((F.col("src") == seed) & (F.col("dst") != seed)).join(goal.select(F.col("id").alias("dst")), "dst", "left_semi")
    found = found.select(F.col("dst").alias("target"), F.array("src", "dst").alias("nodes"), F.array("relation").alias("relations"), "weakest")
    for n in range(2, hops + 1):
        full = found.groupBy("target").count().where(F.col("count") >= most)
        open_ = goal.join(full.select(F.col("target").alias("id")), "id", "left_anti") if n > 2 else goal
        left = front(e, seed, allowed, min(2, n - 1), most)
        right = back(e, open_, seed, allowed, max(1, n - 2), most, left if n > 3 else None).withColumnRenamed("weakest", "_w")
        found = found.unionByName(_ranked(_joined(left, right), most).drop("rank"))
    return _ranked(found, most).withColumn("hops", F.size("relations")).withColumnRenamed("weakest", "min_confidence").select("target", "nodes", "relations", "hops", "min_confidence", "rank")


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    met = left.join(right, "at").where(~F.arrays_overlap("nodes", "rest"))
    return met.select("target", F.concat("nodes", "rest").alias("nodes"), F.concat("relations", "more").alias("relations"), F.least("weakest", "_w").alias("weakest"))


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("target").orderBy(F.size("relations"), F.col("weakest").desc(), "nodes")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


