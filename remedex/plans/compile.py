"""Queries of the compiling operators over orders, lines, parts and suppliers as source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedex.functions import labels
from remedex.operators import compile as k
from remedex.plans import query
from remedex.sources.tables import table


@query("build_mapped_union", """WITH m AS (SELECT p_partkey AS old, p_partkey % 50 AS new FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 50 + p_size FROM part WHERE p_size > 10),
a AS (SELECT m.new AS a, l_suppkey AS b FROM lineitem JOIN m ON l_partkey = m.old), u AS (SELECT a, b FROM a UNION SELECT p_partkey, p_size FROM part)
SELECT a, b FROM u WHERE b IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def build_mapped_union(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size")
    big = part.where("p_size > 10")
    m = big.select(F.col("p_partkey").alias("old"), (F.col("p_partkey") % 50).alias("new")).unionByName(big.select(F.col("p_partkey").alias("old"), (F.col("p_size") + 50).cast("bigint").alias("new")))
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    u = k.union_of([k.mapped(pairs, "a", m), part.select(F.col("p_partkey").alias("a"), F.col("p_size").cast("bigint").alias("b"))])
    return k.within(u, b=table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")).select("a", "b")


@query("build_mapped_or_own", "SELECT DISTINCT coalesce(s_nationkey + 1000, l_suppkey) AS a FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey < 12")
def build_mapped_or_own(spark, d):
    m = table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("old"), (F.col("s_nationkey") + 1000).cast("bigint").alias("new"))
    return k.mapped(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a")).distinct(), "a", m, keep=True).distinct()


@query("build_species_route", "WITH s AS (SELECT p_partkey AS id, p_brand AS species FROM part WHERE p_size < 45), p AS (SELECT DISTINCT l_partkey AS a, (l_partkey * 7) % 97 AS b FROM lineitem) SELECT a, b, CASE WHEN x.species = y.species THEN x.species ELSE 'OTHER' END AS species FROM p JOIN s x ON a = x.id JOIN s y ON b = y.id")
def build_species_route(spark, d):
    s = table(spark, d, "part").where("p_size < 45").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("species"))
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), ((F.col("l_partkey") * 7) % 97).alias("b")).distinct()
    return k.species_route(pairs, s)


@query("build_expression_levels", "SELECT DISTINCT l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'medium' END AS level, 'T' || (l_suppkey % 10) AS tissue, l_linestatus AS cell FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def build_expression_levels(spark, d):
    level = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "medium").otherwise("none")
    place = F.concat(F.lit("T"), (F.col("l_suppkey") % 10).cast("string"), F.lit("__"), F.col("l_linestatus"))
    return k.level_triples(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), level.alias("level"), place.alias("place")), ("low", "medium", "high"))


@query("build_tree_prefixes", "WITH t AS (SELECT p_partkey, 'C' || (p_partkey % 30) || '.' || p_size || '.' || (p_partkey % 7) AS number FROM part), x AS (SELECT p_partkey, string_split(number, '.') AS s FROM t) SELECT array_to_string(s[1 : i], '.') AS node, count(DISTINCT p_partkey) AS n FROM x, (VALUES (1), (2), (3)) v(i) GROUP BY ALL")
def build_tree_prefixes(spark, d):
    n = F.col("p_partkey")
    number = F.concat_ws(".", F.concat(F.lit("C"), (n % 30).cast("string")), F.col("p_size").cast("string"), (n % 7).cast("string"))
    x = table(spark, d, "part").select("p_partkey", F.explode(k.tree_prefixes(number)).alias("node"))
    return x.groupBy("node").agg(F.count_distinct("p_partkey").alias("n"))


@query("build_code_levels", "WITH t AS (SELECT o_custkey, 'A' || lpad((o_custkey % 90)::VARCHAR, 2, '0') || 'BC' || lpad((o_orderkey % 20)::VARCHAR, 2, '0') AS code FROM orders), x AS (SELECT o_custkey, unnest([code[1:1], code[1:3], code[1:4], code[1:5], code]) AS level FROM t) SELECT level, count(DISTINCT o_custkey) AS customers FROM x GROUP BY level")
def build_code_levels(spark, d):
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    code = F.concat(F.lit("A"), pad(F.col("o_custkey") % 90), F.lit("BC"), pad(F.col("o_orderkey") % 20))
    x = table(spark, d, "orders").select("o_custkey", F.explode(k.code_levels(code)).alias("level"))
    return x.groupBy("level").agg(F.count_distinct("o_custkey").alias("customers"))


@query("build_action_conflicts", "WITH s AS (SELECT l_partkey, l_suppkey, list_sort(list(DISTINCT l_returnflag)) AS x FROM lineitem GROUP BY ALL), y AS (SELECT l_partkey, l_suppkey, CASE WHEN list_contains(x, 'A') AND list_contains(x, 'R') THEN list_filter(x, lambda v: v NOT IN ('A', 'R')) ELSE x END AS x FROM s) SELECT l_partkey, l_suppkey, array_to_string(x, ',') AS actions FROM y WHERE len(x) > 0")
def build_action_conflicts(spark, d):
    out = k.conflicts_out(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag", ("A", "R"))
    return out.withColumn("actions", F.array_join("actions", ","))


@query("build_references", "SELECT l_partkey AS a, l_suppkey AS b, array_to_string(list_sort(list(DISTINCT l_orderkey::VARCHAR)), ',') AS \"references\" FROM lineitem WHERE l_quantity > 30 AND (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL")
def build_references(spark, d):
    line = table(spark, d, "lineitem")
    pair = [F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")]
    rows = line.select(*pair, F.when(F.col("l_quantity") > 30, F.col("l_orderkey").cast("string")).alias("ref"))
    return k.with_references(rows, line.where("l_returnflag = 'R'").select(*pair).distinct(), "ref")


@query("build_effect_benchmark", "SELECT DISTINCT greatest(l_partkey, l_suppkey) AS a, least(l_partkey, l_suppkey) AS b, l_returnflag AS effect FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt')")
def build_effect_benchmark(spark, d):
    wanted = table(spark, d, "part").where(F.col("p_name").contains("ring") | F.col("p_name").contains("bolt")).select("p_partkey")
    line = k.within(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), l_partkey=wanted)
    return line.select(F.greatest("l_partkey", "l_suppkey").alias("a"), F.least("l_partkey", "l_suppkey").alias("b"), F.col("l_returnflag").alias("effect")).distinct()


@query("build_text_keys", "SELECT p_partkey, regexp_replace(trim(p_name || ' (' || p_type || ')'), '[^a-zA-Z0-9]', '_', 'g') AS clean, lower(replace(trim(p_name), ' ', '_')) AS effect FROM part")
def build_text_keys(spark, d):
    text = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", labels.sanitised(text).alias("clean"), labels.effect_key(F.col("p_name")).alias("effect"))


@query("build_interaction_effects", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'increase_' || replace(p_name, ' ', '_') WHEN 1 THEN 'decrease_serum_concentration,decrease_excretion_rate' WHEN 2 THEN 'increase_sedation,increase_hypotension' ELSE '' END AS effects FROM part""")
def build_interaction_effects(spark, d):
    n = F.col("p_partkey") % 4
    text = (
        F.when(n == 0, F.concat(F.lit("The risk or severity of "), "p_name", F.lit(" can be increased when A is combined with B.")))
        .when(n == 1, F.lit("A may decrease the excretion rate of B which could result in a lower serum level."))
        .when(n == 2, F.lit("The risk or severity of sedative and hypotensive activities can be increased when A is combined with B."))
        .otherwise(F.col("p_name"))
    )
    return table(spark, d, "part").select("p_partkey", text.alias("t")).select("p_partkey", F.array_join(k.interaction_effects(F.col("t")), ",").alias("effects"))


@query("build_entity_types", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'drug' WHEN 1 THEN 'disease' WHEN 2 THEN 'genetic_disorder' WHEN 3 THEN 'biological_process' WHEN 4 THEN 'complex' WHEN 5 THEN 'gene/protein' ELSE 'other' END AS kind FROM part""")
def build_entity_types(spark, d):
    n, s = F.col("p_partkey") % 7, F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    id_ = F.when(n == 0, F.concat(F.lit("DB"), s)).when(n == 1, F.concat(F.lit("D"), s)).when(n == 2, s).when(n == 3, F.concat(F.lit("GO:"), s)).when(n == 4, F.concat(F.lit("R-HSA-"), s, F.lit("-x"))).when(n == 5, F.concat(F.lit("P"), F.substring(s, 2, 5))).otherwise("?")
    return table(spark, d, "part").select("p_partkey", id_.alias("i")).select("p_partkey", labels.entity_type(F.col("i")).alias("kind"))


@query("build_dates", "SELECT o_orderkey, last_day(make_date(2000 + (o_orderkey % 20)::INT, 1 + (o_orderkey % 12)::INT, 1)) AS day FROM orders")
def build_dates(spark, d):
    n = F.col("o_orderkey")
    month = F.date_format(F.make_date(F.lit(2000), (1 + n % 12).cast("int"), F.lit(1)), "MMMM")
    return table(spark, d, "orders").select("o_orderkey", k.clamped_date((2000 + n % 20).cast("int"), month, F.lit("31")).alias("day"))
