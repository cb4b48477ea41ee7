"""Queries of the bounded searches and the requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedex.functions import requests as rq
from remedex.functions import text as t
from remedex.operators import graph as g
from remedex.operators import retrieval as r
from remedex.operators import search as s
from remedex.plans import graph as base
from remedex.plans import query
from remedex.plans import retrieval as patents
from remedex.plans import targets
from remedex.sources.settle import stored
from remedex.sources.tables import table


def _capped(hops: int) -> str:
    out = ["goal AS (SELECT 'P' || p_partkey AS id FROM part)", f"f0 AS (SELECT '{base.SEED}' AS at, ['{base.SEED}'] AS nodes, []::VARCHAR[] AS rels)"]
    for i in range(1, hops + 1):
        out.append(f"x{i} AS (SELECT e.dst, list_append(f.nodes, e.dst) AS nodes, list_append(f.rels, e.relation) AS rels, {base._CAP} AS cap, row_number() OVER (PARTITION BY f.nodes ORDER BY {base._ORDER}) AS n FROM f{i - 1} f JOIN e ON e.src = f.at WHERE NOT list_contains(f.nodes, e.dst))")
        out.append(f"f{i} AS (SELECT dst AS at, nodes, rels FROM x{i} WHERE n <= cap AND substr(dst, 1, 1) NOT IN ('C', 'O'))")
    every = " UNION ALL ".join(f"SELECT dst, nodes, rels FROM x{i}" for i in range(1, hops + 1))
    out.append(f"b AS (SELECT dst AS target, nodes, len(rels)::INT AS hops, row_number() OVER (PARTITION BY dst ORDER BY len(rels), nodes) AS n FROM ({every}) WHERE dst IN (SELECT id FROM goal))")
    out.append("k AS (SELECT *, (CASE WHEN hops = 1 THEN 1 ELSE CASE substr(nodes[2], 1, 1) WHEN 'S' THEN 3 WHEN 'P' THEN 2 WHEN 'R' THEN 4 ELSE 1 END END)::DOUBLE AS context_weight FROM b WHERE n <= 5)")
    return ", ".join(out)


@query("kg_target_metapaths", f"WITH {base.EDGES}, {_capped(3)} SELECT target, array_to_string(nodes, '>') AS path, hops, context_weight, row_number() OVER (PARTITION BY target ORDER BY context_weight DESC, hops, nodes)::INT AS rank FROM k")
def kg_target_metapaths(spark, d):
    """Five paths of each part, found with the caps of each kind of node."""
    goal = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    found = s.capped_paths(base.typed_edges(spark, d), base.SEED, goal, base._CAPS, base.bfs_weight, base.KIND, lambda c: ~base.KIND(c).isin("C", "O"), other=1 << 30)
    return found.select("target", F.array_join("nodes", ">").alias("path"), "hops", "context_weight", "rank")


_SHOWN = f"""WITH {base.EDGES}, {targets._SCORED}, {targets._HEAD}, dg AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src),
r AS (SELECT s3.id, hop, degree, g.id IS NOT NULL AS t, row_number() OVER (PARTITION BY hop ORDER BY g.id IS NOT NULL DESC, degree DESC, s3.id) AS n FROM s3 JOIN dg ON s3.id = dg.id LEFT JOIN h g ON s3.id = g.id),
sn AS (SELECT id, hop, degree::DOUBLE AS i, t FROM r WHERE n <= 33 OR t)"""


@query("target_display_scores", f"""{_SHOWN}, m AS (SELECT min(i) AS lo, max(i) AS hi FROM sn)
SELECT id, hop, least(round((i - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END * 100 * greatest(1.0::DOUBLE - hop * 0.15::DOUBLE, 0.3::DOUBLE) * CASE WHEN t THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END
* (1.0::DOUBLE + 0.3::DOUBLE * (CASE substr(id, 1, 1) WHEN 'S' THEN 0.75::DOUBLE WHEN 'P' THEN 0.5::DOUBLE WHEN 'R' THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END)), 2), 100.0::DOUBLE) AS importance FROM sn, m""")
def target_display_scores(spark, d):
    """The nodes of the shown tree with their scores as shown; the degree is their importance."""
    tree, ranked = targets.shown(spark, d)
    shown = tree.select(F.lit(base.SEED).alias("graph"), "id", "hop", F.col("degree").cast("double").alias("importance"))
    return s.display_scores(shown, ranked, lambda c: base.bfs_weight(c) / 4).drop("graph")


@query("target_graph_statistics", f"""{_SHOWN}, l AS (SELECT count(*) AS links FROM e WHERE src < dst AND src IN (SELECT id FROM sn) AND dst IN (SELECT id FROM sn)), c AS (SELECT count(*) AS nodes FROM sn)
SELECT '{base.SEED}' AS graph, nodes, links, round(2 * links / nodes::DOUBLE, 2) AS avg_degree, CASE WHEN nodes > 1 THEN round(links / (nodes * (nodes - 1))::DOUBLE, 4) ELSE 0 END AS density FROM c, l""")
def target_graph_statistics(spark, d):
    shown = stored(targets.target_grown_subgraph(spark, d).select("id"))
    links = g.touching(g.touching(base.edges(spark, d).where("src < dst").select("src", "dst"), shown), shown, "dst")
    graph = F.lit(base.SEED).alias("graph")
    return s.graph_statistics(shown.select(graph, "id"), links.select(graph, "src", "dst"))


@query("resolve_loosely")
def resolve_loosely(spark, d):
    """Stated names by form, ratio or containment; SQL has no such ratio."""
    names = stored(table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")))  # read at each step of the search
    return s.loosely_named(names, ("smal ring", "blue", "zzzz of the long and quite unlike small ring of all parts"))


_FETCHED = "fetched AS (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20)"


@query("patent_retrieved", f"""WITH {_FETCHED}, {patents.BM25.replace('FROM documents', 'FROM fetched')},
u AS (SELECT id, row_number() OVER (ORDER BY round(score, 7) DESC, id) AS rank FROM s UNION ALL SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM fetched),
z AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY id), o AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k, count(*) OVER () AS n FROM z),
p AS (SELECT id, (n - k + 11) / 2.0::DOUBLE + CASE WHEN id % 10 = 0 THEN 6 ELSE 0 END AS raw FROM o), q2 AS (SELECT id, 1 + 9 * (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS score FROM p)
SELECT id, round(score, 3) AS relevance_score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM q2 ORDER BY score DESC, id LIMIT 5""")
def patent_retrieved(spark, d):
    docs = table(spark, d, "documents")
    order = r.ranked(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score")), 20).select("id", F.col("rank").alias("api_rank"))
    found = docs.select(F.col("doc_id").alias("id"), t.hyphen_tokens(F.col("text")).alias("tokens")).join(order, "id")
    return s.retrieved(found, patents.QUERY, F.when(F.col("id") % 10 == 0, 6.0).otherwise(0.0))


@query("lit_mining_keywords", """WITH x AS (SELECT l_orderkey AS request, 'S' || l_suppkey AS protein, 'flag ' || l_returnflag AS disease, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'S' || l_suppkey || ' in flag ' || l_returnflag) AS n FROM lineitem),
y AS (SELECT * FROM x WHERE n <= 5), c AS (SELECT request, disease, min(n) AS n FROM y GROUP BY ALL), a AS (SELECT request, string_agg(disease, ',' ORDER BY n) AS context FROM c GROUP BY request)
SELECT y.request, string_agg(protein, ',' ORDER BY n) AS proteins, any_value(context) AS context FROM y JOIN a ON y.request = a.request GROUP BY y.request""")
def lit_mining_keywords(spark, d):
    phrase = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit(" in flag "), "l_returnflag")
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("position"), phrase.alias("phrase"))
    return s.mining_keywords(asked).select("request", F.array_join("proteins", ",").alias("proteins"), F.array_join("context", ",").alias("context"))


@query("lit_query_entities", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'AMPK' WHEN 1 THEN 'JAK2' END AS target, CASE p_partkey % 3 WHEN 0 THEN 'type 2 diabetes' WHEN 1 THEN 'breast cancer' END AS disease FROM part")
def lit_query_entities(spark, d):
    n = F.col("p_partkey") % 3
    q = F.when(n == 0, "What role does AMPK have in type 2 diabetes?").when(n == 1, F.concat("p_name", F.lit(": JAK2 drives breast cancer"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", rq.asked_target(q).alias("target"), rq.asked_disease(q).alias("disease"))


@query("build_accepted_names", "SELECT p_partkey, p_name FROM part WHERE p_size % 3 = 0 AND p_name <> ''")
def build_accepted_names(spark, d):
    n = F.col("p_size") % 3
    raw = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat(F.lit("TG(16:0) "), "p_name")).otherwise(F.concat("p_name", F.lit(" [isoform]")))
    return table(spark, d, "part").select("p_partkey", raw.alias("p_name")).where(rq.accepted_name(F.col("p_name")))


@query("patent_answer_keys", "SELECT p_partkey, substr(sha256(p_name), 1, 16) AS query, array_to_string(list_sort([p_type, p_brand]), ',') AS ids, CASE p_partkey % 3 WHEN 0 THEN 'multi_patent' WHEN 1 THEN 'single_patent' ELSE 'multiple_patent' END AS mode FROM part")
def patent_answer_keys(spark, d):
    ids = F.array("p_type", "p_brand")
    key = rq.answer_key(F.col("p_name"), ids)
    named = F.slice(ids, F.lit(1), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, d, "part").select("p_partkey", key["query"].alias("query"), F.array_join(key["ids"], ",").alias("ids"), rq.answer_mode(named).alias("mode"))


@query("patent_preferred_chunks", "WITH h AS (SELECT l_suppkey AS question, l_partkey AS chunk_id, bool_or(l_returnflag = 'R') AS preferred, max(l_quantity) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY preferred DESC, score DESC, chunk_id)::INT AS rank FROM h) SELECT question, chunk_id, preferred, score, rank FROM r WHERE rank <= 6")
def patent_preferred_chunks(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("question"), F.col("l_partkey").alias("chunk_id"), F.col("l_quantity").alias("score"), "l_returnflag")
    return s.preferred_first(hits, F.col("l_returnflag") == "R", 6)
