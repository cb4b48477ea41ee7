"""Queries of the recommendations, expansions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedex.operators import advice as a
from remedex.operators import graph as g
from remedex.operators import resolve
from remedex.plans import graph as base
from remedex.plans import query
from remedex.sources.settle import stored
from remedex.sources.tables import table


@query("kg_expanded_node", f"WITH {base.EDGES}, o AS (SELECT 0 AS side, a AS source, b AS target, b AS other FROM t WHERE a = 'S1' UNION SELECT 1, a, b, a FROM t WHERE b = 'S1') SELECT side, source, target FROM o ORDER BY side, other LIMIT 60")
def kg_expanded_node(spark, d):
    return a.expanded(base.triples(spark, d), "S1")


@query("kg_with_neighbours", f"WITH {base.EDGES} SELECT 'C' || c_custkey AS id FROM customer WHERE 'C' || c_custkey IN (SELECT src FROM e WHERE dst LIKE 'O%')")
def kg_with_neighbours(spark, d):
    ids = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    return a.with_neighbours(base.edges(spark, d), ids, lambda c: c.startswith("O"))


@query("build_member_filter", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def build_member_filter(spark, d):
    members = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(members, "l_suppkey", "left_semi").distinct().select("l_partkey", "l_suppkey")


@query("app_wire_rows", "SELECT p_partkey AS nodeId, coalesce(nullif(trim(p_name), ''), 'P' || p_partkey) AS displayName, CASE WHEN p_type LIKE '%STEEL%' THEN 'protein' WHEN p_type LIKE '%BRASS%' THEN 'drug' ELSE 'other' END AS nodeType, p_partkey IN (SELECT l_partkey FROM lineitem) AS indexed FROM part")
def app_wire_rows(spark, d):
    known = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id"))
    kind = F.when(F.col("p_type").contains("STEEL"), "protein").when(F.col("p_type").contains("BRASS"), "drug").otherwise("other")
    nodes = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"))
    out = a.wire_rows(nodes, known, lambda i: F.concat(F.lit("P"), i))
    return out.withColumn("nodeId", F.col("nodeId").cast("bigint"))


@query("target_gold_rescale", "SELECT p_partkey AS id, round(100 * p_retailprice / (SELECT max(p_retailprice) FROM part), 2) AS score FROM part")
def target_gold_rescale(spark, d):
    from remedex.operators.targets import relative

    scored = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return relative(scored).select("id", F.round("relevance", 2).alias("score"))


_CAND = "c AS (SELECT l_suppkey AS session, l_partkey AS id, bool_or(l_returnflag = 'R' AND l_quantity > 30) AS known, bool_or(l_quantity >= 49) AND l_suppkey % 3 <> 0 AS confirmed, CASE WHEN count(*) > 1 AND l_suppkey % 2 = 0 THEN 'High' ELSE 'Low' END AS novelty, max(l_extendedprice) AS score FROM lineitem GROUP BY l_suppkey, l_partkey)"


def _candidates(spark, d):
    s = F.col("l_suppkey")
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30)).alias("known"), F.bool_or(F.col("l_quantity") >= 49).alias("q"), F.count("*").alias("n"), F.max("l_extendedprice").alias("score"))
    return c.select(s.alias("session"), F.col("l_partkey").alias("id"), "known", (F.col("q") & (s % 3 != 0)).alias("confirmed"), F.when((F.col("n") > 1) & (s % 2 == 0), "High").otherwise("Low").alias("novelty"), "score")


@query("target_recommendation", f"""WITH {_CAND}, k AS (SELECT session, list(id ORDER BY score DESC, id)[1:3] AS known FROM c WHERE known GROUP BY session),
o AS (SELECT session, arg_min(id, (-score, id)) FILTER (NOT known AND confirmed AND novelty IN ('High', 'Moderate')) AS op, arg_min(id, (-score, id)) FILTER (NOT known AND confirmed) AS su FROM c GROUP BY session),
j AS (SELECT o.*, coalesce(known, []) AS known FROM o LEFT JOIN k USING (session))
SELECT session, CASE WHEN op IS NOT NULL THEN 'literature_mining' WHEN su IS NOT NULL AND len(known) > 0 THEN 'user_choice' WHEN su IS NOT NULL THEN 'literature_mining' WHEN len(known) > 0 THEN 'drug_curation' ELSE 'none' END AS action,
array_to_string(CASE WHEN op IS NOT NULL THEN [op] WHEN su IS NOT NULL AND len(known) > 0 THEN [su, known[1]] WHEN su IS NOT NULL THEN [su] ELSE known END, ',') AS candidates FROM j""")
def target_recommendation(spark, d):
    return a.recommended(_candidates(spark, d)).withColumn("candidates", F.array_join("candidates", ","))


@query("resolve_suggestions")
def resolve_suggestions(spark, d):
    """Near misses: the five names that are most like each query from a ratio of 0.3; SQL has no such ratio."""
    q = spark.createDataFrame([("smal ring",), ("blot",)], "query string")
    names = stored(table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")))  # read at each step of the search
    return resolve.fuzzy(q, names, least=0.3, top=5).groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))  # five names


@query("resolve_by_reference", "WITH r AS (SELECT DISTINCT upper(p_brand) AS w, p_partkey FROM part UNION SELECT upper(p_type), p_partkey FROM part) SELECT wanted, min(p_partkey) AS id FROM (VALUES ('brand#11'), ('Brand#55'), ('absent')) v(wanted) JOIN r ON upper(wanted) = w GROUP BY wanted")
def resolve_by_reference(spark, d):
    hits = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("rank"), F.array("p_brand", "p_type").alias("xrefs"))
    return a.by_reference(hits, spark.createDataFrame([("brand#11",), ("Brand#55",), ("absent",)], "wanted string"))


@query("resolve_compounds", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: len(w) >= 4 AND w <> 'ring'), ',') AS compounds FROM part")
def resolve_compounds(spark, d):
    part = table(spark, d, "part")
    asked = F.concat(F.lit("Dock these against JAK2: "), "p_name", F.lit(", "), F.initcap("p_name"), F.lit(" ring RING"))
    return part.select("p_partkey", F.array_join(a.compounds(asked, F.lit("Ring")), ",").alias("compounds"))


@query("profile_molecule_fields", """SELECT p_partkey, p_retailprice AS molecular_weight, CASE p_size % 3 WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS orphan_designation, CASE WHEN p_size > 25 THEN 'withdrawn' ELSE 'not_withdrawn' END AS withdrawn_status,
CASE WHEN p_size <= 25 THEN 'not_withdrawn' ELSE CASE p_size % 4 WHEN 0 THEN 'commercial' WHEN 1 THEN 'efficacy' WHEN 2 THEN 'safety' ELSE 'unknown' END END AS withdrawal_reason FROM part""")
def profile_molecule_fields(spark, d):
    n = F.col("p_size") % 4
    reason = F.when(n == 0, "Voluntary, after hepatotoxicity").when(n == 1, "Lack of effect; death").when(n == 2, "Nephrotoxic").otherwise("risk on the market")
    m = F.struct(F.col("p_retailprice").cast("string").alias("full_mwt"), F.lit("x").alias("alogp"), F.when(F.col("p_size") % 3 == 2, -1).otherwise(F.col("p_size") % 3).alias("orphan"), (F.col("p_size") > 25).alias("withdrawn"), reason.alias("reason"), F.lit(1).alias("oral"))
    return table(spark, d, "part").select("p_partkey", a.molecule_fields(m).alias("f")).select("p_partkey", "f.molecular_weight", "f.orphan_designation", "f.withdrawn_status", "f.withdrawal_reason")


@query("lit_validated_evidence", r"""WITH c(name) AS (VALUES ('reader'), ('The'), ('absentword')), x AS (SELECT lower(coalesce(text, '')) AS t FROM documents),
h AS (SELECT name, regexp_matches(t, '\bthation|\bwith') AS near FROM c JOIN x ON regexp_matches(t, '\b' || lower(name)))
SELECT c.name, count(h.name) AS articles, count(*) FILTER (near) AS validated, CASE WHEN count(*) FILTER (near) > 0 THEN 'evidence-backed' ELSE 'score-only' END AS strength FROM c LEFT JOIN h ON c.name = h.name GROUP BY c.name""")
def lit_validated_evidence(spark, d):
    names = spark.createDataFrame([("reader",), ("The",), ("absentword",)], "name string")
    return a.evidence(table(spark, d, "documents"), names, ("thation", "with"))


@query("profile_leaders", "WITH c AS (SELECT s_nationkey AS session, s_name AS name, s_acctbal / 100 AS score, s_acctbal > 5000 AS backed FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY session, backed ORDER BY score DESC, name) AS n, max(backed) OVER (PARTITION BY session) AS a FROM c) SELECT session, any_value(a) AS backed, string_agg(name || ' (' || round_even(score, 0)::BIGINT || '/100)', ', ' ORDER BY n) AS headline FROM r WHERE n <= 3 AND backed = a GROUP BY session")
def profile_leaders(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("session"), F.col("s_name").alias("name"), (F.col("s_acctbal") / 100).alias("score"), (F.col("s_acctbal") > 5000).alias("backed"))
    return a.leaders(s)


@query("patent_row_ids", "SELECT doc_id, sha1(doc_id || ':' || lang) AS row_id FROM documents")
def patent_row_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", a.row_id("doc_id", "lang").alias("row_id"))


@query("patent_store_statistics", "SELECT count(*) AS chunks, count(DISTINCT label) AS patents, 20 AS cap FROM embeddings")
def patent_store_statistics(spark, d):
    return a.store_statistics(table(spark, d, "embeddings"), "label", 20)


@query("patent_context", "WITH r AS (SELECT source AS patent, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) SELECT patent, count(*) AS used, string_agg(doc_id, ',' ORDER BY n) AS ids FROM r WHERE n <= 4 GROUP BY patent")
def patent_context(spark, d):
    chunks = table(spark, d, "documents").select(F.col("source").alias("patent"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return a.context_per_patent(chunks, 4).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("patent_report_split", "SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN c_name || ' end' ELSE c_name END AS answer, CASE c_custkey % 3 WHEN 0 THEN 'Recommended next steps: go' WHEN 1 THEN 'RECOMMENDED NEXT STEPS' || chr(10) || 'x' ELSE '' END AS next FROM customer")
def patent_report_split(spark, d):
    n = F.col("c_custkey") % 3
    text = F.concat("c_name", F.when(n == 0, F.lit("\n  Recommended next steps: go ")).when(n == 1, F.lit("\n\nRECOMMENDED NEXT STEPS\nx")).otherwise(F.lit(" end\n")))
    return table(spark, d, "customer").select("c_custkey", a.split_report(text).alias("r")).select("c_custkey", "r.answer", "r.next")


@query("build_names", "SELECT DISTINCT id, name FROM (SELECT 'S' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'C' || c_custkey, c_name FROM customer UNION ALL SELECT 'P' || p_partkey, p_name FROM part)")
def build_names(spark, d):
    parts = [("supplier", "S", "s_suppkey", "s_name"), ("customer", "C", "c_custkey", "c_name"), ("part", "P", "p_partkey", "p_name")]
    named = [table(spark, d, n).select(F.concat(F.lit(k), F.col(i).cast("string")).alias("id"), F.col(c).alias("name")) for n, k, i, c in parts]
    return a.name_table(named)


@query("build_name_pivot", "WITH s AS (SELECT l_partkey AS id, arg_min(l_suppkey, (l_orderkey, l_linenumber)) FILTER (l_returnflag = 'A') AS f, arg_min(l_suppkey, (l_orderkey, l_linenumber)) FILTER (l_returnflag = 'N') AS s, bool_or(l_returnflag = 'R') AS h FROM lineitem GROUP BY 1) SELECT 'P' || id AS id, CASE WHEN f IS NOT NULL THEN 'full ' || f WHEN s IS NOT NULL THEN 's' || s ELSE 'P' || id END AS display FROM s WHERE h")
def build_name_pivot(spark, d):
    flag = F.col("l_returnflag")
    k = F.col("l_suppkey").cast("string")
    attribute = F.when(flag == "A", "FULL_NAME").when(flag == "N", "SHORT_NAME").otherwise("SPECIES")
    value = F.when(flag == "A", F.concat(F.lit("full "), k, F.lit(" {ECO:1}"))).when(flag == "N", F.concat(F.lit("s"), k)).otherwise(F.lit("HUMAN"))
    long = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id"), attribute.alias("attribute"), value.alias("value"), F.struct("l_orderkey", "l_linenumber").alias("line"))
    return a.name_pivot(long)


@query("build_graph_counts", f"WITH {base.EDGES} SELECT coalesce(r, 'TOTAL') AS grp, count(*) AS n FROM (SELECT DISTINCT a, r, b FROM t) GROUP BY ROLLUP (r)")
def build_graph_counts(spark, d):
    """The compiled graph's relations with their numbers of distinct statements."""
    return g.group_report(base.triples(spark, d).distinct(), "edge_type")


@query("build_approved_pairs", "SELECT DISTINCT l_partkey AS drug, l_suppkey AS protein FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 40)")
def build_approved_pairs(spark, d):
    approved = table(spark, d, "part").where("p_size >= 40").select(F.col("p_partkey").alias("drug"))
    return a.approved_pairs(table(spark, d, "lineitem").select(F.col("l_partkey").alias("drug"), F.col("l_suppkey").alias("protein")), approved)


@query("app_recommendation_trail", "SELECT conv_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY turn, text)) AS digest FROM conversations WHERE role = 'assistant' AND coalesce(text, '') <> '' GROUP BY conv_id")
def app_recommendation_trail(spark, d):
    steps = table(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("turn").alias("step"), F.col("text").alias("recommendation"))
    return a.recommendation_trail(steps).select(F.col("session").alias("conv_id"), F.size("trail").cast("bigint").alias("n"), F.md5(F.array_join("trail", "|")).alias("digest"))


@query("app_carried_targets", "WITH b AS (SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3) SELECT 'screen' AS stage, id, id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS found FROM b UNION ALL SELECT 'novelty', id, id IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 0) FROM b")
def app_carried_targets(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_quantity")
    targets = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return a.carried(targets, {"screen": line.where("l_quantity > 45").select("id"), "novelty": line.where("l_quantity < 0").select("id")})
