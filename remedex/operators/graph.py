"""Knowledge-graph operators: symmetric index, layer-aware walk weights, random walk with restart, degree correction,
bounded paths and the sourcing gate.  Edges are (src, dst, relation); the node type is a column of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.operators.walks import converged
from remedex.sources.settle import stored


def symmetric(triples: DataFrame) -> DataFrame:
    """Both directions of every edge without self loops; parallel edges collapse to the largest relation name.

    An edge is shuffled once, whichever way it was stated; its directions are made after that. Columns ``source_kind`` and
    ``target_kind``, which follow from the ids, become ``ks`` and ``kd``; where each source of triples states them as literals, a
    filter on them leaves out whole scans.
    """
    if "source_kind" in triples.columns:
        back = (F.col("source_kind") > F.col("target_kind")) | ((F.col("source_kind") == F.col("target_kind")) & (F.col("source") > F.col("target")))
        end = lambda x, y: F.when(back, F.col(x)).otherwise(F.col(y))
        ends = triples.where("source <> target").select(end("target", "source").alias("a"), end("source", "target").alias("b"), end("target_kind", "source_kind").alias("ka"), end("source_kind", "target_kind").alias("kb"), F.col("edge_type").alias("relation"))
        pairs = ends.groupBy("a", "b", "ka", "kb").agg(F.max("relation").alias("relation"))
        way = lambda *c: pairs.select(*[F.col(x).alias(y) for x, y in zip(c, ("src", "dst", "ks", "kd"))], "relation")
        return way("a", "b", "ka", "kb").unionByName(way("b", "a", "kb", "ka"))
    ends = triples.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col("edge_type").alias("relation"))
    pairs = ends.groupBy("a", "b").agg(F.max("relation").alias("relation"))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "relation").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "relation"))


def symmetric_by_source(triples: DataFrame) -> DataFrame:
    """``symmetric`` with all edges of a node in one part, for what counts by node and joins the counts back."""
    e = triples.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("edge_type").alias("relation")).where("src <> dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    return e.unionByName(back).repartition("src").groupBy("src", "dst").agg(F.max("relation").alias("relation"))


def touching(edges: DataFrame, nodes: DataFrame, end: str = "src") -> DataFrame:
    """Edges that have an end among nodes (id). If these are few, Spark looks them up in the scans, before edges are made unique."""
    return edges.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")


def leaving(edges: DataFrame, nodes: DataFrame, kind) -> DataFrame:
    """Edges from nodes (id). Where edges name their kinds (``ks``, ``kd``), those of the nodes, which are few, are asked first, and
    Spark scans only what can leave them."""
    if "ks" in edges.columns:
        edges = edges.where(F.col("ks").isin(kinds_of(nodes, kind)))
    return touching(edges, nodes)


def kinds_of(nodes: DataFrame, kind) -> list[str]:
    """The kinds of nodes (id), as many as the graph has at most."""
    return [r.k for r in nodes.select(kind(F.col("id")).alias("k")).where("k IS NOT NULL").distinct().collect()]


def kind_steps(pairs: Sequence[tuple[str, str]], start: str, goals: Sequence[str], closed: Sequence[str], hops: int) -> list[tuple[list[str], list[str]]]:
    """For each hop of a path the kinds that it may leave and those that it may enter, so that it can still end in a goal's kind.

    ``pairs`` are the kinds that edges join, either way; a path goes on from all but the ``closed`` kinds.
    """
    both = {*pairs, *((b, a) for a, b in pairs)}
    onward = [set()]  # kinds from which a goal is within 0, 1, .. hops
    for _ in range(hops):
        onward.append({a for a, b in both if b in goals or (b in onward[-1] and b not in closed)})
    out, at = [], {start}
    for left in reversed(range(hops)):
        into = {b for a, b in both if a in at and (b in goals or (b in onward[left] and b not in closed))}
        out.append((sorted(at), sorted(into)))
        at = (into & onward[left]) - set(closed)
    return out


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def layered_weights(edges: DataFrame, kind, jump: float = 0.5) -> DataFrame:
    """src, dst, w: a walker stays in its layer or jumps to another. ``kind`` maps an id column to its layer.

    The counts of a node come from its (src, layer) totals, which are aggregated to one row before they are joined back. Edges that are
    dealt by ``src`` are not shuffled again.
    """
    e = edges.select("src", "dst", kind(F.col("src")).alias("ks"), kind(F.col("dst")).alias("kd"))
    layer = e.groupBy("src", "ks", "kd").agg(F.count("*").alias("n"))
    same = F.col("ks") == F.col("kd")
    node = layer.groupBy("src").agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("n_same"), F.sum(F.when(same, 0).otherwise(1)).alias("n_layers"), F.map_from_entries(F.collect_list(F.struct("kd", "n"))).alias("counts"))
    met = e.join(node, "src").withColumn("n", F.element_at("counts", F.col("kd")))
    return met.select("src", "dst", layer_share(same, F.col("n"), F.col("n_same"), F.col("n_layers"), jump).alias("w"))


def weights_by_source(triples: DataFrame, kind, jump: float = 0.5) -> DataFrame:
    """``layered_weights`` of the symmetric edges of all triples, with one shuffle and one sort and nothing joined back.

    Edges are dealt by ``src`` and sorted by (src, layer, dst). Windows in that order drop repeats and count a layer and then a node;
    they spill what a hub holds.
    """
    e = triples.select(F.col("source").alias("src"), F.col("target").alias("dst")).where("src <> dst")
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).repartition("src")
    e = e.withColumns({"kd": kind(F.col("dst")), "same": kind(F.col("src")) == kind(F.col("dst"))})
    layer, node = W.partitionBy("src", "kd"), W.partitionBy("src")
    met = e.withColumns({"before": F.lag("dst").over(layer.orderBy("dst")), "i": F.row_number().over(layer.orderBy("dst"))})
    met = met.where("before IS NULL OR before <> dst").withColumn("n", F.count("*").over(layer))
    met = met.withColumn("n_same", F.max(F.when(F.col("same"), F.col("n")).otherwise(0)).over(node))
    met = met.withColumn("n_layers", F.count_if((F.col("i") == 1) & ~F.col("same")).over(node))
    return met.select("src", "dst", layer_share(F.col("same"), F.col("n"), F.col("n_same"), F.col("n_layers"), jump).alias("w"))


def layer_share(same: Column, n: Column, n_same: Column, n_layers: Column, jump: float) -> Column:
    """The weight of one of ``n`` edges into a layer, for a node of ``n_same`` edges in its own layer and ``n_layers`` other layers."""
    lam = F.when((n_same > 0) & (n_layers > 0), F.lit(jump)).when(n_same > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(same, (1 - lam) / n).otherwise(lam / n_layers / n)


def walk(weights: DataFrame, seeds: DataFrame, steps: int, restart: float = 0.3, normalise: bool = True) -> DataFrame:
    """id, p after some steps of the walk from the seeds (id, p). ``seed`` as a further column walks many at once."""
    by = [c for c in seeds.columns if c not in ("id", "p")]
    start = seeds.select(*by, "id", (F.col("p") * restart).alias("p"))
    p = seeds
    for _ in range(steps):
        moved = p.withColumnRenamed("id", "src").join(weights, "src").select(*by, F.col("dst").alias("id"), (F.col("p") * F.col("w") * (1 - restart)).alias("p"))
        p = moved.unionByName(start).groupBy(*by, "id").agg(F.sum("p").alias("p"))
    if normalise:  # the weights of a node add up to 1, so one division at the end equals one in each step
        total = p.groupBy(*by).agg(F.sum("p").alias("_t")) if by else p.agg(F.sum("p").alias("_t"))
        p = (p.join(total, by) if by else p.crossJoin(total)).select(*by, "id", (F.col("p") / F.col("_t")).alias("p"))  # one row of totals
    return p


def degree_matched(degrees: DataFrame, n_samples: int = 100) -> DataFrame:
    """Nodes (id) drawn by hash, a fourth of the number from each quartile of the degree, or all that it has."""
    x = F.log1p(F.col("degree"))
    cuts = degrees.agg(F.percentile(x, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("cuts"))  # one row
    bucket = degrees.crossJoin(cuts).select("id", F.size(F.filter("cuts", lambda c: c <= x)).alias("q"))
    n = F.row_number().over(W.partitionBy("q").orderBy(F.xxhash64("id"), "id"))
    return bucket.withColumn("n", n).where(F.col("n") <= max(1, n_samples // 4)).select("id")


def null_zscore(weights: DataFrame, seed, drawn: DataFrame, **walk_options) -> DataFrame:
    """id, p, z: the converged scores of a seed against their mean and deviation over walks from the drawn nodes (id); all walk together.

    A node that no drawn walk reaches has the mean and deviation 0.
    """
    drawn = stored(drawn.select("id"))
    k = max(drawn.count(), 1)
    own = weights.sparkSession.range(1).select(F.lit(seed).cast(drawn.schema["id"].dataType).alias("id"), F.lit(True).alias("own"))
    seeds = drawn.withColumn("own", F.lit(False)).union(own).select("own", F.col("id").alias("seed"), "id", F.lit(1.0).alias("p"))
    own, null = F.col("own"), F.when(~F.col("own"), F.col("p"))
    seen = converged(weights, seeds, **walk_options).groupBy("id").agg(F.max(F.when(own, F.col("p"))).alias("p"), F.sum(null).alias("s"), F.sum(null * null).alias("q"))
    mean, sq = F.coalesce("s", F.lit(0.0)) / k, F.coalesce("q", F.lit(0.0)) / k
    sd = F.sqrt(F.greatest(F.lit(0.0), sq - mean * mean))
    return seen.where("p IS NOT NULL").select("id", "p", ((F.col("p") - mean) / F.greatest(sd, F.lit(1e-15))).alias("z"))


def log_factorial(n: Column) -> Column:
    """ln n!: a table below 16, Stirling's series from there."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 16, F.element_at(small, F.least(n, F.lit(15)).cast("int") + 1)).otherwise(series)


def hypergeometric_tail(x: Column, n: Column, k: Column, m: Column) -> Column:
    """P(X >= x) for n draws from m with k marked; within [1e-300, 1]."""
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    top, low = F.least(k, n), F.greatest(x, n + k - m)
    terms = F.transform(F.sequence(low, top), lambda i: F.exp(choose(k, i) + choose(m - k, n - i) - choose(m, n)))
    p = F.when(x <= 0, F.lit(1.0)).when(low > top, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), p))


def degree_corrected(edges: DataFrame, region: DataFrame, candidates: DataFrame, nodes: Column) -> DataFrame:
    """Candidates (id) with degree, observed and expected neighbours in the region, and -log10 of the tail."""
    own = edges.join(candidates.select(F.col("id").alias("src")), "src", "left_semi")
    marked = own.join(region.select(F.col("id").alias("dst"), F.lit(1).alias("hit")), "dst", "left")
    seen = marked.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum(F.coalesce("hit", F.lit(0))).alias("observed"))
    size = region.count()  # the region has a fixed bound
    inside = region.select("id", F.lit(1).alias("self"))
    out = candidates.select("id").join(seen, "id", "left").join(inside, "id", "left").na.fill(0, ["degree", "observed", "self"])
    m = (nodes - 1).cast("bigint")
    k = (F.lit(size) - F.col("self")).cast("bigint")
    n = F.least(F.col("degree"), m)
    return out.select("id", "degree", "observed", (n * k / m).alias("expected"), (-F.log10(hypergeometric_tail(F.col("observed"), n, k, m))).alias("score"))


def cap_per_group(scored: DataFrame, group: str, score: str, cap: int, key: str = "id") -> DataFrame:
    """The best rows of each group, by score and then key."""
    best = W.partitionBy(group).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cap)


def paths(edges: DataFrame, seed: str, targets: DataFrame, allowed, hops: int = 3, steps: Sequence[tuple[list[str], list[str]]] | None = None, goals: Sequence[str] = ()) -> DataFrame:
    """Simple paths from the seed to the targets (id) of up to ``hops`` edges, as arrays of nodes and relations.

    ``allowed`` says whether an id may be an intermediate; the last hop starts from the targets' side of the edges. With ``steps``
    (``kind_steps``) and the targets' kinds ``goals``, edges name their kinds, and a hop reads only edges on the way to a target.
    """
    within = (lambda df, k: df.where(F.col("ks").isin(steps[k][0]) & F.col("kd").isin(steps[k][1]))) if steps else (lambda df, k: df)
    ends = (lambda df: df.where(F.col("kd").isin(list(goals)))) if steps else (lambda df: df)
    kept = ["kd"] if steps else []
    e = edges.select("src", "dst", "relation", *(["ks", *kept] if steps else []))
    past = e.where(allowed(F.col("src")))  # the edges that leave an intermediate
    reach = within(e, 0).where(F.col("src") == seed).select("dst", *kept, F.array("src", "dst").alias("nodes"), F.array("relation").alias("relations"))
    goal = targets.select(F.col("id").alias("dst"))
    out = ends(reach).drop(*kept).join(goal, "dst", "left_semi")
    for k in range(1, hops):
        if steps and not steps[k][0]:
            break  # no kind that was entered leads on to a target
        if steps:
            reach = reach.where(F.col("kd").isin(steps[k][0]))
        open_ = stored(reach.where(allowed(F.col("dst"))).drop(*kept))
        step = within(past, k)
        step = ends(step).join(goal, "dst", "left_semi") if k == hops - 1 else touching(step, open_.select(F.col("dst").alias("id")))
        last = open_.withColumnRenamed("dst", "at").join(step.withColumnRenamed("src", "at"), "at").where(~F.array_contains("nodes", F.col("dst")))
        reach = last.select("dst", *kept, F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"))
        out = out.unionByName(reach.drop(*kept) if k == hops - 1 else ends(reach).drop(*kept).join(goal, "dst", "left_semi"))
    return out.withColumnRenamed("dst", "target").withColumn("hops", F.size("relations"))


def describe(found: DataFrame, registry: dict[str, float], gate: float = 0.6) -> DataFrame:
    """Confidences, weakest confidence, whether all edges are sourced, and the type path."""
    m = F.create_map(*[F.lit(x) for kv in registry.items() for x in kv])
    conf = F.transform("relations", lambda r: F.coalesce(F.element_at(m, r), F.lit(0.0)))
    out = found.withColumn("confidences", conf)
    return out.withColumns({"min_confidence": F.array_min("confidences"), "fully_sourced": F.forall("confidences", lambda c: c >= gate), "metapath": F.array_join(F.transform("nodes", lambda n: F.substring(n, 1, 1)), ">")})


def best_paths(described: DataFrame, most: int = 5) -> DataFrame:
    """The shortest paths of each target, of these the surest, then by nodes."""
    order = W.partitionBy("target").orderBy("hops", F.col("min_confidence").desc(), "nodes")
    return described.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def gate(described: DataFrame) -> DataFrame:
    """Per target: confirmed if some path is sourced throughout, else the weakest link of its surest path."""
    return described.groupBy("target").agg(F.bool_or("fully_sourced").alias("confirmed"), F.count("*").alias("n_paths"), F.max("min_confidence").alias("best_confidence"), F.min("hops").alias("hops"))


def capped_bfs(edges: DataFrame, seed: str, caps: dict[str, int], weight, kind, levels: int) -> DataFrame:
    """id, parent, hop of a breadth-first tree: a node passes on its heaviest neighbours up to its type's cap."""
    seeds = edges.sparkSession.createDataFrame([("one", seed)], "graph string, id string")
    return capped_trees(edges, seeds, caps, weight, kind, levels).drop("graph")


def capped_trees(edges: DataFrame, seeds: DataFrame, caps: dict[str, int], weight, kind, levels: int) -> DataFrame:
    """graph, id, parent, hop: the trees of ``capped_bfs`` for many seeds (graph, id) at once. Edges may name their kinds (``ks``, ``kd``)."""
    seen = stored(seeds.select("graph", "id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hop")))
    front = seen
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    for level in range(1, levels + 1):
        near = front.select("graph", F.col("id").alias("src")).join(leaving(edges, front, kind).select("src", "dst"), "src")
        order = W.partitionBy("graph", "src").orderBy(weight(F.col("dst")).desc(), "dst")
        near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.coalesce(F.element_at(cap, kind(F.col("src"))), F.lit(1 << 30)))
        new = near.join(seen.select("graph", F.col("id").alias("dst")), ["graph", "dst"], "left_anti")
        front = stored(new.groupBy("graph", F.col("dst").alias("id")).agg(F.min("src").alias("parent")).withColumn("hop", F.lit(level)))
        seen = seen.unionByName(front)
    return seen


def union_distinct_pairs(parts: Sequence[DataFrame]) -> DataFrame:
    """Unordered pairs (a, b) of several sources, each once with the smaller end first."""
    out = parts[0].select("a", "b")
    for p in parts[1:]:
        out = out.unionByName(p.select("a", "b"))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def conflict_split(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) with one effect only; those found with both effects are in conflict and go."""
    return rows.groupBy("a", "b").agg(F.min("effect").alias("effect"), F.max("effect").alias("_m")).where("effect = _m").drop("_m")


def group_report(df: DataFrame, by: str) -> DataFrame:
    """Rows of each group and a TOTAL row."""
    return df.rollup(by).agg(F.count("*").alias("n"), F.grouping_id().alias("_g")).select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(by)).alias("grp"), "n")
