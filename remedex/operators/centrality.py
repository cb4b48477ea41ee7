"""Degree, closeness and betweenness of many graphs at once, level by level.

Links are rows (graph, src, dst) with both directions.  Forward, a front of (graph, source, node) rows moves one link a step and adds
up the numbers of shortest paths; backward, from the last level to the first, each node hands its dependency to the nodes
before it in proportion to these numbers.  A level is one join and one aggregation over all graphs and sources, written before the
next; the number of levels is the longest distance in any of the graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.sources.settle import Steps, settled

_BY = ["graph", "source"]


def centrality(links: DataFrame, sources: int = 100) -> DataFrame:
    """graph, id, degree, closeness, betweenness, scaled to the size of the graph.

    Betweenness counts shortest paths from ``sources`` nodes of each graph, drawn by hash, or from all if there are no
    more; closeness is exact, with the share of the graph that a node reaches as a factor.
    """
    with Steps(links.sparkSession) as steps:
        e = steps.put(links.where("src <> dst").select("graph", "src", "dst").distinct())
        nodes = e.groupBy("graph", F.col("src").alias("id")).agg(F.count("*").alias("near"))
        drawn = F.row_number().over(W.partitionBy("graph").orderBy(F.xxhash64("id"), "id")) <= sources
        nodes = steps.put(nodes.withColumns({"n": F.count("*").over(W.partitionBy("graph")), "drawn": drawn}))
        levels = [steps.put(nodes.select("graph", F.col("id").alias("source"), "id", F.lit(1.0).alias("ways")))]
        seen = levels[0].select(*_BY, "id")
        while True:
            step = levels[-1].withColumnRenamed("id", "src").join(e, ["graph", "src"]).groupBy(*_BY, F.col("dst").alias("id")).agg(F.sum("ways").alias("ways"))
            # A node two levels back or more cannot be next to this level, so two levels are all that must be left out.
            known = seen if len(levels) < 2 else levels[-1].select(*_BY, "id").unionByName(levels[-2].select(*_BY, "id"))
            new = steps.put(step.join(known, [*_BY, "id"], "left_anti"))
            if new.isEmpty():
                break
            levels.append(new)
        far = levels[0].select(*_BY, F.lit(0).alias("hop"))
        for k, level in enumerate(levels[1:], 1):
            far = far.unionByName(level.select(*_BY, F.lit(k).alias("hop")))
        far = far.groupBy(*_BY).agg(F.sum("hop").alias("total"), F.count("*").alias("reached"))
        chosen = nodes.where("drawn").select("graph", F.col("id").alias("source"))
        owed, parts = None, []
        for level in reversed(levels[1:]):
            level = level.join(chosen, _BY, "left_semi")
            if owed is None:
                here = level.withColumn("owed", F.lit(0.0))
            else:
                up = owed.select(*_BY, F.col("id").alias("dst"), ((1 + F.col("owed")) / F.col("ways")).alias("share"))
                up = up.join(e, ["graph", "dst"]).groupBy(*_BY, F.col("src").alias("id")).agg(F.sum("share").alias("share"))
                here = level.join(up, [*_BY, "id"], "left").select(*_BY, "id", "ways", (F.col("ways") * F.coalesce("share", F.lit(0.0))).alias("owed"))
            owed = steps.put(here)
            parts.append(owed.select("graph", "id", "owed"))
        between = parts[0] if parts else levels[0].select("graph", "id", F.lit(0.0).alias("owed"))
        for p in parts[1:]:
            between = between.unionByName(p)
        between = between.groupBy("graph", "id").agg(F.sum("owed").alias("owed"))
        out = nodes.join(far.withColumnRenamed("source", "id"), ["graph", "id"]).join(between, ["graph", "id"], "left")
        others = F.greatest(F.col("n") - 1, F.lit(1))
        reach = F.col("reached") - 1
        close = F.when(F.col("total") > 0, reach / F.col("total") * reach / others).otherwise(0.0)
        pairs = F.greatest((F.col("n") - 1) * (F.col("n") - 2), F.lit(1))
        scale = F.col("n") / F.least(F.col("n"), F.lit(sources))
        return settled(out.select("graph", "id", (F.col("near") / others).alias("degree"), close.alias("closeness"), (F.coalesce("owed", F.lit(0.0)) / pairs * scale).alias("betweenness")))


def importance(links: DataFrame, weight, sources: int = 100) -> DataFrame:
    """Adds ``importance``: the weighted sum of the three, times the weight of the node, relative to the graph's highest."""
    raw = (0.4 * F.col("degree") + 0.4 * F.col("betweenness") + 0.2 * F.col("closeness")) * weight(F.col("id"))
    top = F.max("importance").over(W.partitionBy("graph"))
    out = centrality(links, sources).withColumn("importance", raw)
    return out.withColumn("importance", F.when(top > 0, F.col("importance") / top).otherwise(0.0))
