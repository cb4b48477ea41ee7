"""Queries of the readers of landed files: lines, pages and records made of the test tables, with the SQL of what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedex.plans import query
from remedex.sources import landed, patents, vendor
from remedex.sources.settle import new_folder
from remedex.sources.tables import spread, table

_PAGE = """'<html><head><script>var claims = 1;</script></head><body><span itemprop="title">' || p_name || '</span><section itemprop="abstract"><h2>Abstract</h2><div>' || p_type || ' &amp; co</div></section>'
|| '<dd itemprop="inventor">' || p_brand || '</dd><dd itemprop="inventor"> A  Wu</dd><time itemprop="filingDate" datetime="2020-01-02">then</time>'
|| '<h3>BACKGROUND OF THE INVENTION</h3><p>Old ' || p_name || '.</p><h3>SUMMARY</h3><p>New ' || p_type || '</p><h3>DETAILED DESCRIPTION</h3><p>Size ' || p_size || '.</p>'
|| CASE WHEN p_partkey % 2 = 0 THEN '<section itemprop="claims"><div class="claim" num="00001"><div class="claim-text">1. A ' || p_name || '</div></div><div class="claim-dependent"><div class="claim" num="00002"><div class="claim-text">2. One of claims 1 to ' || (3 + p_size) || '</div></div></div></section>'
   ELSE '<p>What is claimed</p><p>1. A ' || p_name || '</p><p>2. As claim 1, of size ' || p_size || '</p>' END || '</body></html>'"""


@query("patent_page_records", r"""SELECT p_partkey, p_name AS title, p_type || ' & co' AS abstract, p_brand || ';A Wu' AS inventors, '2020-01-02' AS filed, 'Old ' || p_name AS background, 'New ' || p_type AS summary,
CASE WHEN p_partkey % 2 = 0 THEN '1:A ' || p_name || ':|2:One of claims 1 to ' || (3 + p_size) || ':1,' || (3 + p_size) ELSE '1:A ' || p_name || ':|2:As claim 1, of size ' || p_size || ':1' END AS claims FROM part""")
def patent_page_records(spark, d):
    r = patents.page_records(spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_PAGE).alias("html")), most=None)
    one = lambda c: F.concat_ws(":", c["number"].cast("string"), c["text"], F.array_join(F.transform(c["depends_on"], lambda n: n.cast("string")), ","))
    part = lambda k: F.try_element_at("sections", F.lit(k)).alias(k)
    return r.select("p_partkey", "title", "abstract", F.array_join("inventors", ";").alias("inventors"), F.col("filing_date").alias("filed"), part("background"), part("summary"), F.array_join(F.transform("claims", one), "|").alias("claims"))


@query("build_protein_links", """WITH k AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT 'P' || l_partkey AS source, 'P' || l_suppkey AS target, l_orderkey::VARCHAR AS ref FROM lineitem JOIN k ON a = l_partkey AND b = l_suppkey WHERE l_linenumber % 3 <> 0 AND l_quantity > 10)
SELECT source, 'INTERACTS_WITH' AS edge_type, target, string_agg(DISTINCT ref, ',' ORDER BY ref) AS "references" FROM r GROUP BY source, target""")
def build_protein_links(spark, d):
    kind = "CASE WHEN l_linenumber % 3 = 0 THEN 'chebi' ELSE 'uniprotkb' END"
    refs = "CASE WHEN l_quantity > 10 THEN concat('imex:IM-1|pubmed:', l_orderkey, '|pubmed:unassigned7') ELSE 'doi:1' END"
    line = table(spark, d, "lineitem")
    rows = line.selectExpr("concat('uniprotkb:P', l_partkey) AS a", f"concat({kind}, ':P', l_suppkey) AS b", f"{refs} AS refs")
    known = line.where("l_returnflag = 'R'").selectExpr("concat('P', l_partkey) AS source", "concat('P', l_suppkey) AS target")
    return vendor.protein_links(rows, known)


@query("build_chemical_actions", """WITH a AS (SELECT l_partkey AS c, l_suppkey AS g, l_orderkey::VARCHAR AS ref, CASE l_returnflag WHEN 'A' THEN 'INCREASES' WHEN 'R' THEN 'DECREASES' ELSE 'AFFECTS' END AS effect, CASE l_linestatus WHEN 'O' THEN 'expression' ELSE 'metabolic_processing' END AS process FROM lineitem WHERE l_suppkey % 4 <> 0),
t AS (SELECT c, g, process, effect, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs FROM a GROUP BY ALL), n AS (SELECT c, g, process FROM t WHERE effect <> 'AFFECTS' GROUP BY ALL HAVING count(*) > 1)
SELECT 'D' || c || x AS source, effect || '_' || process AS edge_type, 'Q' || g AS target, refs AS "references" FROM t, (VALUES ('a'), ('b')) v(x) WHERE effect = 'AFFECTS' OR NOT EXISTS (SELECT 1 FROM n WHERE n.c = t.c AND n.g = t.g AND n.process = t.process)""")
def build_chemical_actions(spark, d):
    effect = "CASE l_returnflag WHEN 'A' THEN 'increases' WHEN 'R' THEN 'decreases' ELSE 'affects' END"
    process = "CASE l_linestatus WHEN 'O' THEN 'expression' ELSE 'metabolic processing' END"
    rows = table(spark, d, "lineitem").selectExpr("l_partkey AS chemical", "l_suppkey AS gene", f"concat({effect}, '^', {process}, '|cotreats^x') AS actions", "cast(l_orderkey AS string) AS refs")
    drugs = table(spark, d, "part").selectExpr("p_partkey AS chemical", "explode(array(concat('D', p_partkey, 'a'), concat('D', p_partkey, 'b'))) AS drug")
    genes = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").selectExpr("s_suppkey AS gene", "concat('Q', s_suppkey) AS protein")
    return vendor.chemical_actions(rows, drugs, genes)


@query("build_complex_members", """SELECT DISTINCT 'Q' || l_suppkey AS source, 'PROTEIN_MEMBER_OF' AS edge_type, 'R-' || l_partkey AS target, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber || ',7' END AS "references" FROM lineitem""")
def build_complex_members(spark, d):
    refs = "CASE WHEN l_linenumber % 2 = 0 THEN concat(l_linenumber, '|7') ELSE '-' END"
    return vendor.complex_members(table(spark, d, "lineitem").selectExpr("concat('R-', l_partkey) AS complex", "concat('chebi:1|uniprot:Q', l_suppkey) AS participants", f"{refs} AS refs"))


@query("build_categories", "SELECT DISTINCT 'MIM:' || p_size AS source, 'CATEGORY' AS edge_type, lower(p_type) || '_kind' AS target FROM part WHERE p_partkey % 5 <> 0")
def build_categories(spark, d):
    mark = "CASE WHEN p_partkey % 5 = 0 THEN '#' ELSE 'C1' END"
    return vendor.category_triples(table(spark, d, "part").selectExpr(f"concat_ws('|', {mark}, p_size, 'b', 'c', 'd', 'e', 'f', 'g', 'h', concat(p_type, ' Kind ')) AS value"))


@query("app_flat_entries", """WITH x AS (SELECT p_partkey, unnest(['name', 'at_size', 'at_tags_0', 'at_tags_1_k']) AS key, unnest([p_name, p_size::VARCHAR, p_brand, p_type]) AS value FROM part) SELECT p_partkey, key, value FROM x WHERE key <> 'at_tags_1_k' UNION ALL SELECT p_partkey, 'at_more_0_k', value FROM x WHERE key = 'at_tags_1_k'""")
def app_flat_entries(spark, d):
    nested = table(spark, d, "part").selectExpr("p_partkey", "p_name AS name", "named_struct('size', p_size, 'tags', array(p_brand), 'more', array(named_struct('k', p_type))) AS at")
    return landed.flat_entries(nested).select("p_partkey", F.explode("flat")).where("key <> 'p_partkey'")


@query("app_declared_totals", "SELECT o_custkey AS zone, round(sum(o_totalprice), 2) AS total_fare FROM orders GROUP BY o_custkey")
def app_declared_totals(spark, d):
    done = landed.materialised(spark, new_folder(spark), {
        "totals": lambda trips: trips.groupBy("zone").agg(F.round(F.sum("fare"), 2).alias("total_fare")),
        "trips": lambda: table(spark, d, "orders").selectExpr("o_custkey AS zone", "o_totalprice AS fare"),
    })
    return done["totals"]
