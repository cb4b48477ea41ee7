"""Searches with bounds: capped paths to targets, scores as shown, loose names, retrieval as one chain, keyword requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.functions.text import target_and_disease
from remedex.operators.graph import kinds_of, leaving
from remedex.operators.resolve import fuzzy, resolved
from remedex.operators.retrieval import bm25, fused, ranked, rescaled
from remedex.sources.settle import stored


def capped_paths(edges: DataFrame, seed: str, targets: DataFrame, caps: dict[str, int], weight, kind, allowed, hops: int = 3, most: int = 5, other: int = 60) -> DataFrame:
    """target, nodes, relations, hops, context_weight, rank: the ``most`` shortest simple paths from the seed to each
    target (id), then by nodes, ranked by the weight of their first intermediate, hops and nodes.

    A path goes on to its heaviest next nodes, up to the cap of the node's kind and where ``allowed``; targets are met
    before the cap. So the front holds at most the product of the caps, and only edges into targets enter the last hop. Where edges
    name their kinds (``ks``, ``kd``), only those that leave the front's kinds are read, in the last hop those into a target's kind.
    """
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    goal = targets.select(F.col("id").alias("dst")).distinct()
    ends = F.col("kd").isin(kinds_of(targets, kind)) if "kd" in edges.columns else F.lit(True)
    front = edges.sparkSession.createDataFrame([(seed, [seed], [])], "at string, nodes array<string>, relations array<string>")
    out = None
    for hop in range(1, hops + 1):
        near = leaving(edges, front.select(F.col("at").alias("id")), kind).withColumnRenamed("src", "at")  # looked up in the scans while the front is small
        into = near if hop < hops else near.where(ends).join(goal, "dst", "left_semi")
        step = front.withColumnRenamed("nodes", "before").join(into, "at").where(~F.array_contains("before", F.col("dst")))
        step = step.withColumns({"nodes": F.concat("before", F.array("dst")), "relations": F.concat("relations", F.array("relation"))})
        found = (step if hop == hops else step.where(ends).join(goal, "dst", "left_semi")).select(F.col("dst").alias("target"), "nodes", "relations")
        out = found if out is None else out.unionByName(found)
        if hop < hops:
            n = F.row_number().over(W.partitionBy("before").orderBy(weight(F.col("dst")).desc(), "dst"))
            within = F.col("_n") <= F.coalesce(F.try_element_at(cap, kind(F.col("at"))), F.lit(other))
            front = stored(step.withColumn("_n", n).where(within & allowed(F.col("dst"))).select(F.col("dst").alias("at"), "nodes", "relations"))
    out = out.withColumn("hops", F.size("relations"))
    first = F.row_number().over(W.partitionBy("target").orderBy("hops", "nodes"))
    context = F.when(F.col("hops") > 1, weight(F.get("nodes", F.lit(1)))).otherwise(1).cast("double")
    out = out.withColumn("_n", first).where(F.col("_n") <= most).drop("_n").withColumn("context_weight", context)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy(F.col("context_weight").desc(), "hops", "nodes")))


def display_scores(nodes: DataFrame, targets: DataFrame, type_weight) -> DataFrame:
    """graph, id, hop, importance of shown nodes (graph, id, hop, importance), out of 100: spread over the graph's range,
    less by 0.15 for each hop (0.3 at least), more for targets (id) and by the weight of the type."""
    ends = nodes.groupBy("graph").agg(F.min("importance").alias("_lo"), F.max("importance").alias("_hi"))
    own = nodes.join(ends, "graph").join(targets.select("id", F.lit(True).alias("_t")).distinct(), "id", "left")
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    spread = (F.col("importance") - F.col("_lo")) / span * 100
    score = spread * F.greatest(1.0 - F.col("hop") * 0.15, F.lit(0.3)) * F.when(F.col("_t"), 1.5).otherwise(1.0) * (1.0 + 0.3 * type_weight(F.col("id")))
    return own.select("graph", "id", "hop", F.least(F.round(score, 2), F.lit(100.0)).alias("importance"))


def graph_statistics(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """graph, nodes, links, avg_degree, density of shown graphs: nodes (graph, id), links (graph, src, dst) in one direction."""
    n = nodes.groupBy("graph").agg(F.count_distinct("id").alias("nodes"))
    m = links.groupBy("graph").agg(F.count("*").alias("links"))
    out = n.join(m, "graph", "left").na.fill(0, ["links"])
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    density = F.when(F.col("nodes") > 1, F.round(F.col("links") / F.greatest(pairs, F.lit(1)), 4)).otherwise(0.0)
    return out.select("graph", "nodes", "links", F.round(2 * F.col("links") / F.col("nodes"), 2).alias("avg_degree"), density.alias("density"))


def loosely_named(names: DataFrame, queries: Sequence[str], least: float = 0.4) -> DataFrame:
    """query, id, way: each stated query's entity (id, name) by a normal form (0), else the closest name of a ratio of
    ``least`` or more (1), else the first name that holds the query or stands in it (2). Other queries have no row."""
    asked = [q for q in dict.fromkeys(queries) if q.strip()]
    q = names.sparkSession.createDataFrame([(x,) for x in asked], "query string")
    low = F.lower("name")
    meets = F.filter(F.array(*map(F.lit, asked)), lambda x: F.contains(low, F.lower(x)) | (F.contains(F.lower(x), low) & (low != "")))
    inside = names.select("id", "name", F.explode(meets).alias("query")).groupBy("query").agg(F.min(F.struct("name", "id")).alias("m"))
    ways = resolved(q, names).where("id IS NOT NULL").select("query", "id", F.lit(0).alias("way"))
    ways = ways.unionByName(fuzzy(q, names, least=least, top=1).select("query", "id", F.lit(1).alias("way")))
    ways = ways.unionByName(inside.select("query", "m.id", F.lit(2).alias("way")))
    return ways.groupBy("query").agg(F.min(F.struct("way", "id")).alias("m")).select("query", "m.id", "m.way")


def retrieved(candidates: DataFrame, query: Sequence[str], pin: Column, top: int = 5, pool: int = 30, multiplier: int = 4) -> DataFrame:
    """id, relevance_score, rank: candidates (id, api_rank, tokens) fetched by their own rank, fused with their BM25 rank,
    cut to a pool, moved up by the pin, spread over 1 to 10 and cut to the best. The pool's order stands for a reranker."""
    size = max(20, top * multiplier)
    fetched = candidates.orderBy("api_rank", "id").limit(size)
    bm = ranked(bm25(fetched.select("id", "tokens"), query).withColumn("score", F.round("score", 7)), size)
    both = fetched.select("id", F.col("api_rank").alias("rank")).unionByName(bm.select("id", "rank"))
    head = ranked(fused(both).withColumn("score", F.round("score", 9)), pool)
    n = head.agg(F.count("*").alias("n"))  # one row
    pinned = head.crossJoin(n).join(fetched.withColumn("pin", pin).select("id", "pin"), "id")
    raw = pinned.select("id", ((F.col("n") - F.col("rank") + 11) / 2 + F.col("pin")).alias("score"))
    return ranked(rescaled(raw), top).select("id", F.round("score", 3).alias("relevance_score"), "rank")


def mining_keywords(asked: DataFrame, most: int = 5) -> DataFrame:
    """request, proteins, context: the first phrases of each request (request, position, phrase) cut into their target and
    the disease; the diseases once each, whatever their case, as first met."""
    first = F.row_number().over(W.partitionBy("request").orderBy("position", "phrase"))
    head = asked.withColumn("n", first).where(F.col("n") <= most).withColumn("c", target_and_disease(F.col("phrase")))
    rows = head.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("rows"))  # ``most`` of a request
    side = lambda k: F.filter(F.transform("rows", lambda r: r["c"][k]), lambda x: x != "")
    rows = rows.select("request", side("target").alias("proteins"), side("disease").alias("all"))
    again = lambda x, i: F.exists(F.slice("all", F.lit(1), i), lambda y: F.lower(y) == F.lower(x))
    return rows.select("request", "proteins", F.filter("all", lambda x, i: ~again(x, i)).alias("context"))


def preferred_first(hits: DataFrame, preferred: Column, top: int) -> DataFrame:
    """The best hits (question, chunk_id, score) of each question, each chunk once, preferred ones before all others."""
    once = hits.withColumn("_p", F.coalesce(preferred, F.lit(False))).groupBy("question", "chunk_id").agg(F.max("_p").alias("preferred"), F.max("score").alias("score"))
    order = W.partitionBy("question").orderBy(F.col("preferred").desc(), F.col("score").desc(), "chunk_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
