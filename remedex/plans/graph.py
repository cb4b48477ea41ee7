"""Queries of the knowledge-graph operators: a typed graph of nations, customers, suppliers, orders, parts, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.operators import graph as g
from remedex.operators.numbered import layered_weights, numbered
from remedex.operators.paths import best_paths
from remedex.operators.walks import converged
from remedex.plans import query
from remedex.sources.settle import settled, stored
from remedex.sources.tables import table

KIND = lambda c: F.substring(c, 1, 1)
SEED = "N3"
#: The kinds that each source of triples joins, in the order of ``triples``.
PAIRS = (("C", "N"), ("S", "N"), ("N", "R"), ("O", "C"), ("P", "S"), ("O", "P"))
#: Kinds that are no intermediates of a path.
CLOSED = ("C", "O")
#: Confidence of each relation; one lies below the gate.
REGISTRY = {"customer_nation": 0.7, "supplier_nation": 0.9, "nation_region": 0.95, "order_customer": 0.65, "part_supplier": 0.8, "order_part": 0.55}

EDGES = """
t AS (SELECT 'C' || c_custkey AS a, 'customer_nation' AS r, 'N' || c_nationkey AS b FROM customer
 UNION ALL SELECT 'S' || s_suppkey, 'supplier_nation', 'N' || s_nationkey FROM supplier
 UNION ALL SELECT 'N' || n_nationkey, 'nation_region', 'R' || n_regionkey FROM nation
 UNION ALL SELECT 'O' || o_orderkey, 'order_customer', 'C' || o_custkey FROM orders
 UNION ALL SELECT 'P' || l_partkey, 'part_supplier', 'S' || l_suppkey FROM lineitem
 UNION ALL SELECT 'O' || l_orderkey, 'order_part', 'P' || l_partkey FROM lineitem),
e AS (SELECT src, dst, max(r) AS relation FROM (SELECT a AS src, b AS dst, r FROM t UNION ALL SELECT b, a, r FROM t) WHERE src <> dst GROUP BY src, dst)"""


def triples(spark: SparkSession, d: str, kinds: bool = False) -> DataFrame:
    """source, edge_type, target of the typed graph, if asked with the literal kinds of both ends."""
    tag = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = [
        (table(spark, d, "customer"), tag("C", "c_custkey"), "customer_nation", tag("N", "c_nationkey")),
        (table(spark, d, "supplier"), tag("S", "s_suppkey"), "supplier_nation", tag("N", "s_nationkey")),
        (table(spark, d, "nation"), tag("N", "n_nationkey"), "nation_region", tag("R", "n_regionkey")),
        (table(spark, d, "orders"), tag("O", "o_orderkey"), "order_customer", tag("C", "o_custkey")),
        (line, tag("P", "l_partkey"), "part_supplier", tag("S", "l_suppkey")),
        (line, tag("O", "l_orderkey"), "order_part", tag("P", "l_partkey")),
    ]
    out = None
    for (df, a, r, b), (ka, kb) in zip(parts, PAIRS):
        one = df.select(a.alias("source"), F.lit(r).alias("edge_type"), b.alias("target"), *([F.lit(ka).alias("source_kind"), F.lit(kb).alias("target_kind")] if kinds else []))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    return g.symmetric(triples(spark, d))


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges with the kinds of their ends (``ks``, ``kd``), for searches that need few kinds."""
    return g.symmetric(triples(spark, d, kinds=True))


@query("kg_edges_symmetric", f"WITH {EDGES} SELECT src, dst, relation FROM e")
def kg_edges_symmetric(spark, d):
    return edges(spark, d)


@query("kg_degree", f"WITH {EDGES} SELECT src AS id, count(*) AS degree FROM e GROUP BY src")
def kg_degree(spark, d):
    return g.degree(edges(spark, d))


@query("kg_neighbour_sets", f"WITH {EDGES} SELECT src AS id, substr(dst, 1, 1) AS kind, count(*) AS n, min(dst) AS first_id, max(dst) AS last_id FROM e GROUP BY ALL")
def kg_neighbour_sets(spark, d):
    e = edges(spark, d)
    return e.groupBy(F.col("src").alias("id"), KIND(F.col("dst")).alias("kind")).agg(F.count("*").alias("n"), F.min("dst").alias("first_id"), F.max("dst").alias("last_id"))


WEIGHTS = """
k AS (SELECT src, dst, substr(src, 1, 1) = substr(dst, 1, 1) AS same, substr(dst, 1, 1) AS kd FROM e),
l AS (SELECT src, count(*) FILTER (same) AS n_same, count(DISTINCT kd) FILTER (NOT same) AS n_layers FROM k GROUP BY src),
c AS (SELECT src, kd, count(*) AS n FROM k GROUP BY src, kd),
m AS (SELECT src, n_same, n_layers, CASE WHEN n_same > 0 AND n_layers > 0 THEN 0.5::DOUBLE WHEN n_same > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS lam FROM l),
w AS (SELECT k.src, k.dst, CASE WHEN same THEN (1 - lam) / n ELSE lam / n_layers / n END AS w FROM k JOIN m ON k.src = m.src JOIN c ON k.src = c.src AND k.kd = c.kd)"""


@query("kg_layer_weights", f"WITH {EDGES}, {WEIGHTS} SELECT src, dst, round(w, 9) AS w FROM w")
def kg_layer_weights(spark, d):
    return g.weights_by_source(triples(spark, d), KIND).select("src", "dst", F.round("w", 9).alias("w"))


#: The walk to its fixed point: 100 steps, where the change of a step has long been below 1e-10.
WALK = f"""
wm AS MATERIALIZED (SELECT * FROM w),
walk(step, id, p) AS (SELECT 0, '{SEED}', 1.0::DOUBLE UNION ALL SELECT step + 1, id, sum(p) FROM (SELECT step, wm.dst AS id, p * w * 0.7::DOUBLE AS p FROM walk JOIN wm ON wm.src = walk.id UNION ALL SELECT DISTINCT step, '{SEED}', 0.3::DOUBLE FROM walk) WHERE step < 100 GROUP BY step, id),
pw AS (SELECT id, p FROM walk WHERE step = 100)"""


def walked(spark, d) -> tuple[DataFrame, DataFrame]:
    """Names (n, id) of the nodes, and n, p of the walk from the seed when a step changes less than 1e-10, or after 100 steps."""
    names, ends = numbered(triples(spark, d), KIND)
    seeds = names.where(F.col("id") == SEED).select(F.col("n").alias("id"), F.lit(1.0).alias("p"))
    return names, converged(layered_weights(names, ends), seeds).withColumnRenamed("id", "n")


@query("kg_random_walk_topk", f"WITH RECURSIVE {EDGES}, {WEIGHTS}, {WALK} SELECT id, round(p, 10) AS p FROM pw WHERE id LIKE 'P%' ORDER BY round(p, 10) DESC, id LIMIT 50")
def kg_random_walk_topk(spark, d):
    names, p = walked(spark, d)
    p = names.where(KIND(F.col("id")) == "P").join(p, "n").select("id", F.round("p", 10).alias("p"))
    return p.orderBy(F.col("p").desc(), "id").limit(50)


_CORRECTED = """
nn AS (SELECT count(DISTINCT src) AS n, least(greatest(200, floor(0.005 * count(DISTINCT src))), (SELECT count(*) FROM pw WHERE id LIKE 'S%' OR id LIKE 'P%') - 1)::BIGINT AS size FROM e),
region AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY round(p, 10) DESC, id) AS r FROM pw WHERE id LIKE 'S%' OR id LIKE 'P%'), nn WHERE r <= size),
cand AS (SELECT id FROM pw WHERE id LIKE 'P%' ORDER BY round(p, 10) DESC, id LIMIT 500),
o AS (SELECT c.id, count(e.dst) AS degree, count(r.id) AS observed FROM cand c JOIN e ON e.src = c.id LEFT JOIN region r ON r.id = e.dst GROUP BY c.id),
h AS (SELECT o.*, least(degree, n - 1) AS nd, n - 1 AS m, size - (SELECT count(*) FROM region r WHERE r.id = o.id) AS k FROM o, nn),
x AS (SELECT id, degree, observed, nd, m, k, unnest(CASE WHEN observed <= least(k, nd) THEN range(greatest(observed, nd + k - m), least(k, nd) + 1) ELSE [NULL] END) AS i FROM h),
s AS (SELECT id, degree, observed, nd, m, k, CASE WHEN observed <= 0 THEN 1.0 ELSE coalesce(sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(m - k + 1) - lgamma(nd - i + 1) - lgamma(m - k - nd + i + 1) - lgamma(m + 1) + lgamma(nd + 1) + lgamma(m - nd + 1))), 0) END AS p FROM x GROUP BY id, degree, observed, nd, m, k)"""


def corrected(spark, d) -> DataFrame:
    """The region holds 200 nodes, or one in 200 of all, but never all that may enter it. Of the edges only the candidates' are read."""
    names, p = walked(spark, d)
    both = stored(names.where(KIND(F.col("id")).isin("S", "P")).join(p, "n").select("id", F.round("p", 10).alias("p")))
    top = lambda df, n: stored(df.orderBy(F.col("p").desc(), "id").limit(n).select("id"))
    nodes = names.count()
    size = min(max(200, nodes // 200), both.count() - 1)
    candidates = top(both.where(KIND(F.col("id")) == "P"), 500)
    return g.degree_corrected(g.leaving(typed_edges(spark, d), candidates, KIND), top(both, size), candidates, F.lit(nodes))


@query("kg_degree_correction", f"WITH RECURSIVE {EDGES}, {WEIGHTS}, {WALK}, {_CORRECTED} SELECT id, degree, observed::BIGINT AS observed, round(nd * k / m, 7) AS expected, round(-log10(greatest(1e-300, least(1.0, p))), 6) AS score FROM s")
def kg_degree_correction(spark, d):
    c = corrected(spark, d)
    return c.select("id", "degree", F.col("observed").cast("bigint").alias("observed"), F.round("expected", 7).alias("expected"), F.round("score", 6).alias("score"))


_KNOWN = "kn AS (SELECT DISTINCT 'P' || l_partkey AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3 AND l_quantity >= 45)"


@query("kg_known_hidden_split", f"""WITH RECURSIVE {EDGES}, {WEIGHTS}, {WALK}, {_CORRECTED}, {_KNOWN},
v AS (SELECT s.id, round(-log10(greatest(1e-300, least(1.0, p))), 6) AS score, CASE WHEN kn.id IS NULL THEN 'hidden' ELSE 'known' END AS category FROM s LEFT JOIN kn ON s.id = kn.id),
z AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS rank FROM v WHERE category = 'known' OR score >= 0.5)
SELECT id, score, category, rank::INT AS rank, round(100 * score / (score + 100), 6) AS squashed FROM z WHERE rank <= 25""")
def kg_known_hidden_split(spark, d):
    line, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    known = line.where("l_quantity >= 45").join(s.where("s_nationkey = 3"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    known = known.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id")).distinct().withColumn("known", F.lit(True))
    c = corrected(spark, d).select("id", F.round("score", 6).alias("score")).join(known, "id", "left")
    c = c.withColumn("category", F.when(F.col("known"), "known").otherwise("hidden")).where("category = 'known' OR score >= 0.5")
    out = g.cap_per_group(c, "category", "score", 25)
    return out.select("id", "score", "category", "rank", F.round(100 * F.col("score") / (F.col("score") + 100), 6).alias("squashed"))


_CONF = "CASE r " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in REGISTRY.items()) + " ELSE 0 END"
_PATHS = f"""
goal AS (SELECT 'P' || p_partkey AS id FROM part),
h1 AS (SELECT src, dst, relation, [src, dst] AS nodes, [relation] AS rels FROM e WHERE src = '{SEED}'),
h2 AS (SELECT e.dst, list_append(nodes, e.dst) AS nodes, list_append(rels, e.relation) AS rels FROM h1 JOIN e ON e.src = h1.dst WHERE substr(h1.dst, 1, 1) NOT IN ('C', 'O') AND NOT list_contains(nodes, e.dst)),
h3 AS (SELECT e.dst, list_append(nodes, e.dst) AS nodes, list_append(rels, e.relation) AS rels FROM h2 JOIN e ON e.src = h2.dst WHERE substr(h2.dst, 1, 1) NOT IN ('C', 'O') AND NOT list_contains(nodes, e.dst)),
u AS (SELECT dst, nodes, rels FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3),
f AS (SELECT dst AS target, nodes, rels, len(rels) AS hops, list_min(list_transform(rels, lambda r: {_CONF})) AS mc FROM u WHERE dst IN (SELECT id FROM goal))"""


def _goal(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))


def _paths(spark, d) -> DataFrame:
    steps = g.kind_steps(PAIRS, SEED[0], ["P"], CLOSED, 3)
    return g.describe(g.paths(typed_edges(spark, d), SEED, _goal(spark, d), lambda c: ~KIND(c).isin(*CLOSED), 3, steps, ["P"]), REGISTRY)


@query("kg_paths_to_3_hops", f"WITH {EDGES}, {_PATHS}, z AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY hops, mc DESC, nodes) AS rank FROM f) SELECT target, array_to_string(nodes, '>') AS path, hops::INT AS hops, mc AS min_confidence, rank::INT AS rank FROM z WHERE rank <= 5")
def kg_paths_to_3_hops(spark, d):
    found = best_paths(settled(edges(spark, d)), SEED, _goal(spark, d), lambda c: ~KIND(c).isin("C", "O"), REGISTRY)
    return found.select("target", F.array_join("nodes", ">").alias("path"), "hops", "min_confidence", "rank")


@query("kg_sourcing_gate", f"WITH {EDGES}, {_PATHS} SELECT target, bool_or(mc >= 0.6::DOUBLE) AS confirmed, count(*) AS n_paths, max(mc) AS best_confidence, min(hops)::INT AS hops FROM f GROUP BY target")
def kg_sourcing_gate(spark, d):
    return g.gate(_paths(spark, d))


@query("kg_metapath_counts", f"WITH {EDGES}, {_PATHS} SELECT array_to_string(list_transform(nodes, lambda n: n[1]), '>') AS metapath, count(*) AS n, count(DISTINCT target) AS targets FROM f GROUP BY 1")
def kg_metapath_counts(spark, d):
    return _paths(spark, d).groupBy("metapath").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


@query("kg_subgraph_links", f"WITH {EDGES}, {_PATHS}, l AS (SELECT unnest(list_transform(range(1, len(nodes)), lambda i: [nodes[i], nodes[i + 1], rels[i]])) AS x FROM f) SELECT x[1] AS src, x[2] AS dst, x[3] AS relation, count(*) AS uses FROM l GROUP BY ALL")
def kg_subgraph_links(spark, d):
    p = _paths(spark, d).select(F.posexplode("relations").alias("i", "relation"), "nodes")
    return p.groupBy(F.get("nodes", "i").alias("src"), F.get("nodes", F.col("i") + 1).alias("dst"), "relation").agg(F.count("*").alias("uses"))


_CAPS = {"N": 30, "S": 20, "R": 5, "P": 10}
_ORDER = "CASE substr(e.dst, 1, 1) WHEN 'S' THEN 3 WHEN 'P' THEN 2 WHEN 'R' THEN 4 ELSE 1 END DESC, e.dst"
_CAP = "CASE substr(e.src, 1, 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CAPS.items()) + " ELSE 1073741824 END"


def _bfs(levels: int) -> str:
    out = [f"s0 AS (SELECT '{SEED}' AS id, NULL::VARCHAR AS parent, 0 AS hop)"]
    for i in range(1, levels + 1):
        out.append(f"n{i} AS (SELECT e.src, e.dst, {_CAP} AS cap, row_number() OVER (PARTITION BY e.src ORDER BY {_ORDER}) AS n FROM s{i - 1} s JOIN e ON e.src = s.id WHERE s.hop = {i - 1})")
        out.append(f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT dst, min(src), {i} FROM n{i} WHERE n <= cap AND dst NOT IN (SELECT id FROM s{i - 1}) GROUP BY dst)")
    return ", ".join(out)


@query("kg_capped_bfs", f"WITH {EDGES}, {_bfs(3)} SELECT id, parent, hop FROM s3")
def kg_capped_bfs(spark, d):
    return g.capped_bfs(typed_edges(spark, d), SEED, _CAPS, bfs_weight, KIND, 3)


def bfs_weight(c):
    return F.when(KIND(c) == "S", 3).when(KIND(c) == "P", 2).when(KIND(c) == "R", 4).otherwise(1)


@query("kg_hop_distribution", f"WITH {EDGES}, {_bfs(3)} SELECT hop, substr(id, 1, 1) AS kind, count(*) AS n FROM s3 GROUP BY ALL")
def kg_hop_distribution(spark, d):
    return kg_capped_bfs(spark, d).groupBy("hop", KIND(F.col("id")).alias("kind")).agg(F.count("*").alias("n"))


@query("kg_pair_union", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem UNION ALL SELECT o_custkey, o_orderkey FROM orders)")
def kg_pair_union(spark, d):
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    pair = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return g.union_distinct_pairs([pair(line, "l_partkey", "l_suppkey"), pair(line, "l_suppkey", "l_partkey"), pair(o, "o_custkey", "o_orderkey")])


@query("kg_conflict_split", "SELECT l_partkey AS a, l_suppkey AS b, min(CASE WHEN l_returnflag = 'R' THEN 'dec' ELSE 'inc' END) AS effect FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag = 'R') = 1")
def kg_conflict_split(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_returnflag") == "R", "dec").otherwise("inc").alias("effect"))
    return g.conflict_split(rows)


@query("kg_group_report", f"WITH {EDGES} SELECT coalesce(relation, 'TOTAL') AS grp, count(*) AS n FROM e GROUP BY ROLLUP (relation)")
def kg_group_report(spark, d):
    return g.group_report(edges(spark, d), "relation")


@query("kg_benchmark_summary", "WITH t AS (SELECT l_partkey AS a, l_returnflag AS r, l_suppkey AS b FROM lineitem) SELECT count(DISTINCT a) AS subjects, count(DISTINCT r) AS relations, count(DISTINCT b) AS objects, count(DISTINCT (least(a, b), greatest(a, b))) AS pairs, count(*) AS total FROM t")
def kg_benchmark_summary(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("r"), F.col("l_suppkey").alias("b"))
    return t.agg(F.count_distinct("a").alias("subjects"), F.count_distinct("r").alias("relations"), F.count_distinct("b").alias("objects"), F.count_distinct(F.struct(F.least("a", "b"), F.greatest("a", "b"))).alias("pairs"), F.count("*").alias("total"))


@query("kg_two_hop_metapaths", f"WITH {EDGES}, m AS (SELECT substr(b.src, 1, 1) AS mid, b.dst AS drug FROM e a JOIN e b ON a.dst = b.src WHERE a.src = '{SEED}' AND b.dst LIKE 'C%'), c AS (SELECT mid, count(*) AS n FROM m GROUP BY mid) SELECT mid, n, round(n / max(n) OVER (), 9) AS attention FROM c")
def kg_two_hop_metapaths(spark, d):
    e = edges(spark, d)
    a = e.where(F.col("src") == SEED).select(F.col("dst").alias("mid"))
    m = a.join(e.where(KIND(F.col("dst")) == "C").withColumnRenamed("src", "mid"), "mid")
    c = m.groupBy(KIND(F.col("mid")).alias("mid")).agg(F.count("*").alias("n"))
    top = c.agg(F.max("n").alias("top"))  # one row
    return c.crossJoin(top).select("mid", "n", F.round(F.col("n") / F.col("top"), 9).alias("attention"))


@query("kg_null_model_zscore")
def kg_null_model_zscore(spark, d):
    """Mean and deviation of the scores over degree-matched seeds, walked together, and z of the seed's own scores."""
    names, ends = numbered(triples(spark, d), KIND)
    w = stored(layered_weights(names, ends))
    degrees = names.where(KIND(F.col("id")) == "N").join(g.degree(w).withColumnRenamed("id", "n"), "n").select("id", "degree")
    drawn = names.join(g.degree_matched(degrees), "id").select(F.col("n").alias("id"))
    seed = next((r.n for r in names.where(F.col("id") == SEED).collect()), None)  # one row at most
    return g.null_zscore(w, seed, drawn).withColumnRenamed("id", "n").join(names, "n").select("id", "p", "z")
