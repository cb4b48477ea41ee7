"""Scores of targets over a context tree: shared neighbours, hop bases, custom targets, relative scores, centrality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.operators.graph import kinds_of, touching
from remedex.sources.settle import stored


def shared_context(edges: DataFrame, seed: str, targets: DataFrame | None, weight, cap: float = 40.0, kind=None, kinds: Sequence[str] = ()) -> DataFrame:
    """id, shared, context: neighbours that each target (id) shares with the seed, and their summed weights up to a cap.

    Only the seed's own neighbours enter the join, so the pairs made are at most the edges that touch them. With ``kind`` edges name
    their kinds (``ks``, ``kd``), and only those between the targets' ``kinds`` and the neighbours' are read; all nodes of ``kinds``
    are targets then if none are given.
    """
    own, out = edges, edges.where(F.col("src") == seed)
    near = stored((out if kind is None else out.where(F.col("ks") == kind(F.lit(seed)))).select(F.col("dst").alias("id")))
    if kind is not None:
        own = own.where(F.col("ks").isin(list(kinds)) & F.col("kd").isin(kinds_of(near, kind)))
    own = touching(own, near, "dst")
    own = own if targets is None else touching(own, targets)
    hit = own.select(F.col("src").alias("id"), F.col("dst").alias("mid"))
    return hit.groupBy("id").agg(F.count("*").alias("shared"), F.least(F.lit(cap), F.sum(weight(F.col("mid")))).alias("context"))


def hop_scores(targets: DataFrame, shared: DataFrame, direct: DataFrame) -> DataFrame:
    """Targets (id, hop) with a score out of 100: a base by hop, direct edges, context, and shared neighbours."""
    hop = F.col("hop")
    base = F.when(hop == 1, 70).when(hop == 2, 40).when(hop == 3, 20).otherwise(3)
    out = targets.join(shared, "id", "left").join(direct.select("id", F.lit(1).alias("_d")), "id", "left").na.fill(0, ["shared", "context", "_d"])
    score = base + F.when(hop == 1, F.least(10 * F.col("_d"), F.lit(20))).otherwise(0) + F.col("context") + F.least(F.col("shared") * F.greatest(F.lit(1), 4 - hop), F.lit(20))
    return out.select("id", "hop", "shared", "context", F.least(F.lit(100.0), score.cast("double")).alias("score"))


def custom_scores(custom: DataFrame, present: DataFrame, known: DataFrame, shared: DataFrame) -> DataFrame:
    """Scores of targets that a user adds: 20 for each shared neighbour up to 100 in the graph, 25 outside; those already
    present are left out."""
    new = custom.select("id").distinct().join(present.select("id"), "id", "left_anti")
    out = new.join(known.select("id", F.lit(True).alias("_k")).distinct(), "id", "left").join(shared.select("id", "shared"), "id", "left")
    return out.select("id", F.when(F.col("_k"), F.least(20.0 * F.coalesce("shared", F.lit(0)), F.lit(100.0))).otherwise(25.0).alias("score"))


def relative(scored: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``relevance``: 100 times the share of the best score."""
    top = scored.agg(F.max(score).alias("_t"))  # one row
    return scored.crossJoin(F.broadcast(top)).withColumn("relevance", F.when(F.col("_t") > 0, 100 * F.col(score) / F.col("_t")).otherwise(0.0)).drop("_t")


def ranked_table(scored: DataFrame, confirmed: Column, top: int = 50) -> DataFrame:
    """The best rows with rank and label; a label says whether a sourced path confirms the target."""
    head = scored.orderBy(F.col("score").desc(), "id").limit(top)
    rank = F.row_number().over(W.orderBy(F.col("score").desc(), "id"))  # of ``top`` rows
    return head.withColumns({"rank": rank, "label": F.concat("id", F.when(confirmed, " (confirmed)").otherwise(" (unconfirmed)"))})


def grown(tree: DataFrame, degree: DataFrame, targets: DataFrame, most: int = 100, hops: int = 3, per: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of a tree (id, hop) kept for display: for each hop a quota of the best connected, and all targets. ``per``
    names columns that tell trees apart."""
    quota = max(10, most // hops)
    rank = F.row_number().over(W.partitionBy(*per, "hop").orderBy(F.col("_t").desc(), F.col("degree").desc(), "id"))
    own = tree.join(degree, "id").join(targets.select("id", F.lit(1).alias("_t")), "id", "left").na.fill(0, ["_t"])
    return own.withColumn("_n", rank).where((F.col("_n") <= quota) | (F.col("_t") == 1)).select(*per, "id", "hop", "degree")


def path_summary(paths: DataFrame) -> DataFrame:
    """Paths (target, nodes, relations) counted: by hops, distinct nodes, links and targets; one row."""
    paths = stored(paths.select("target", "nodes", "relations"))
    steps = paths.select("target", F.size("relations").alias("hops"), F.explode("nodes").alias("node"))
    links = paths.select(F.posexplode("relations").alias("i", "relation"), "nodes")
    n = paths.agg(F.count("*").alias("paths"), F.count_distinct("target").alias("targets"), F.count_if(F.size("relations") == 1).alias("hop_1"), F.count_if(F.size("relations") == 2).alias("hop_2"), F.count_if(F.size("relations") == 3).alias("hop_3"))
    nodes = steps.agg(F.count_distinct("node").alias("nodes"))
    edges = links.select(F.get("nodes", "i").alias("a"), F.get("nodes", F.col("i") + 1).alias("b"), "relation").distinct().agg(F.count("*").alias("links"))
    return n.crossJoin(nodes).crossJoin(edges)  # three single rows
