"""Queries of the target scores over the typed graph of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedex.operators import graph as g
from remedex.operators import targets as tg
from remedex.operators.centrality import importance
from remedex.plans import graph as base
from remedex.plans import query
from remedex.sources.settle import stored
from remedex.sources.tables import table

SEED, KIND, EDGES = base.SEED, base.KIND, base.EDGES
_WEIGHTS = {"S": 0.8, "R": 1.0, "N": 0.95, "C": 0.3}
_W_SQL = "CASE substr(a.dst, 1, 1) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _WEIGHTS.items()) + " ELSE 0.2::DOUBLE END"
_SHARED = f"sh AS (SELECT b.src AS id, count(*) AS shared, round(least(40.0::DOUBLE, sum({_W_SQL})), 6) AS context FROM e a JOIN e b ON a.dst = b.dst WHERE a.src = '{SEED}' AND b.src LIKE 'P%' GROUP BY b.src)"


def weight(c):
    out = F.lit(0.2)
    for k, v in reversed(_WEIGHTS.items()):
        out = F.when(KIND(c) == k, v).otherwise(out)
    return out


def _shared(e, targets=None):
    """Of the targets (id), or of all parts that have edges."""
    return tg.shared_context(e, SEED, targets, weight, kind=KIND, kinds=["P"]).withColumn("context", F.round("context", 6))


@query("target_shared_context", f"WITH {EDGES}, {_SHARED} SELECT * FROM sh")
def target_shared_context(spark, d):
    return _shared(base.typed_edges(spark, d))


_SCORED = f"""{base._bfs(3)}, {_SHARED},
tt AS (SELECT id, hop FROM s3 WHERE id LIKE 'P%'),
sc AS (SELECT tt.id, hop, coalesce(shared, 0) AS shared, coalesce(context, 0) AS context, least(100.0::DOUBLE, CASE hop WHEN 1 THEN 70 WHEN 2 THEN 40 WHEN 3 THEN 20 ELSE 3 END + CASE WHEN hop = 1 AND tt.id IN (SELECT dst FROM e WHERE src = '{SEED}') THEN 10 ELSE 0 END + coalesce(context, 0) + least(coalesce(shared, 0) * greatest(1, 4 - hop), 20)) AS score FROM tt LEFT JOIN sh ON tt.id = sh.id)"""


def _scores(spark, d, tree=None):
    e = base.typed_edges(spark, d)
    near = stored((base.kg_capped_bfs(spark, d) if tree is None else tree).where(KIND(F.col("id")) == "P").select("id", "hop"))  # at most the product of the caps
    direct = e.where((F.col("ks") == KIND(F.lit(SEED))) & (F.col("kd") == "P") & (F.col("src") == SEED)).select(F.col("dst").alias("id"))
    return tg.hop_scores(near, _shared(e, near), direct)


@query("target_hop_scores", f"WITH {EDGES}, {_SCORED} SELECT id, hop, shared, round(context, 6) AS context, round(score, 6) AS score FROM sc")
def target_hop_scores(spark, d):
    return _scores(spark, d).select("id", "hop", "shared", F.round("context", 6).alias("context"), F.round("score", 6).alias("score"))


@query("target_relevance", f"WITH {EDGES}, {_SCORED} SELECT id, round(100 * score / (SELECT max(score) FROM sc), 6) AS relevance FROM sc")
def target_relevance(spark, d):
    return tg.relative(_scores(spark, d)).select("id", F.round("relevance", 6).alias("relevance"))


@query("target_ranked_table", f"WITH {EDGES}, {_SCORED}, h AS (SELECT id, round(score, 6) AS score, shared FROM sc ORDER BY round(score, 6) DESC, id LIMIT 50) SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank, id || CASE WHEN shared > 2 THEN ' (confirmed)' ELSE ' (unconfirmed)' END AS label FROM h")
def target_ranked_table(spark, d, tree=None):
    s = _scores(spark, d, tree).withColumn("score", F.round("score", 6))
    return tg.ranked_table(s, F.col("shared") > 2).select("id", "score", "rank", "label")


@query("target_custom", f"WITH {EDGES}, {base._bfs(3)}, {_SHARED}, c AS (SELECT DISTINCT 'P' || (p_partkey * 3) AS id FROM part), k AS (SELECT DISTINCT src AS id FROM e) SELECT c.id, CASE WHEN k.id IS NOT NULL THEN least(20.0::DOUBLE * coalesce(shared, 0), 100.0::DOUBLE) ELSE 25.0::DOUBLE END AS score FROM c LEFT JOIN k ON c.id = k.id LEFT JOIN sh ON c.id = sh.id WHERE c.id NOT IN (SELECT id FROM s3)")
def target_custom(spark, d):
    custom = table(spark, d, "part").select(F.concat(F.lit("P"), (F.col("p_partkey") * 3).cast("string")).alias("id"))
    ends = base.triples(spark, d).where("source <> target").select(F.explode(F.array("source", "target")).alias("id")).where(KIND(F.col("id")) == "P")  # all custom targets are parts
    return tg.custom_scores(custom, base.kg_capped_bfs(spark, d), ends, _shared(base.typed_edges(spark, d)))


_HEAD = "h AS (SELECT id, round(score, 6) AS score, shared FROM sc ORDER BY round(score, 6) DESC, id LIMIT 50)"


@query("target_grown_subgraph", f"WITH {EDGES}, {_SCORED}, {_HEAD}, dg AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src), r AS (SELECT s3.id, hop, degree, g.id IS NOT NULL AS t, row_number() OVER (PARTITION BY hop ORDER BY g.id IS NOT NULL DESC, degree DESC, s3.id) AS n FROM s3 JOIN dg ON s3.id = dg.id LEFT JOIN h g ON s3.id = g.id) SELECT id, hop, degree FROM r WHERE n <= 33 OR t")
def target_grown_subgraph(spark, d):
    """The tree of the seed as it is shown: the best connected nodes of each hop, and the ranked targets."""
    return shown(spark, d)[0]


def shown(spark, d):
    """The shown tree, and the ranked table that its targets come from."""
    tree = base.kg_capped_bfs(spark, d)
    ranked = stored(target_ranked_table(spark, d, tree))
    return tg.grown(tree.select("id", "hop"), g.degree(g.leaving(base.typed_edges(spark, d), stored(tree), KIND)), ranked), ranked


@query("target_path_summary", f"WITH {EDGES}, {base._PATHS}, n AS (SELECT unnest(nodes) AS x FROM f), l AS (SELECT DISTINCT unnest(list_transform(range(1, len(nodes)), lambda i: [nodes[i], nodes[i + 1], rels[i]])) AS x FROM f) SELECT count(*) AS paths, count(DISTINCT target) AS targets, count(*) FILTER (hops = 1) AS hop_1, count(*) FILTER (hops = 2) AS hop_2, count(*) FILTER (hops = 3) AS hop_3, (SELECT count(DISTINCT x) FROM n) AS nodes, (SELECT count(*) FROM l) AS links FROM f")
def target_path_summary(spark, d):
    return tg.path_summary(base._paths(spark, d))


@query("target_importance")
def target_importance(spark, d):
    """Centrality within the shown trees of all nations, one graph for each; betweenness has no SQL form."""
    e = base.typed_edges(spark, d)
    seeds = e.where(F.col("ks") == "N").select(F.col("src").alias("graph"), F.col("src").alias("id")).distinct()
    trees = g.capped_trees(e, seeds, base._CAPS, base.bfs_weight, KIND, 2)
    shown = stored(tg.grown(trees.select("graph", "id", "hop"), g.degree(g.leaving(e, stored(trees), KIND)), spark.createDataFrame([], "id string"), per=("graph",)).select("graph", "id"))
    near = g.touching(g.leaving(e, shown, KIND), shown, "dst").select("src", "dst")
    links = shown.withColumnRenamed("id", "src").join(near, "src").join(shown.withColumnRenamed("id", "dst"), ["graph", "dst"])
    return importance(links.select("graph", "src", "dst"), weight).select("graph", "id", *[F.round(c, 9).alias(c) for c in ("degree", "closeness", "betweenness", "importance")])
