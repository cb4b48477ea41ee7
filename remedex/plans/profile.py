"""Queries of the profile operators: parts as candidates, their size, price and quantity as numbers, their brand and type
as categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedex.functions import labels
from remedex.operators import profile as p
from remedex.plans import query
from remedex.sources.tables import table

NUMERIC, CATEGORICAL = ("p_size", "p_retailprice", "quantity"), ("p_brand", "p_type")
#: criterion, weight, lower is better, category scores, order, group
CRITERIA = (
    ("p_size", 30, True, {}, 1, "shape"),
    ("p_retailprice", 25, False, {}, 2, "trade"),
    ("quantity", 20, False, {}, 3, "trade"),
    ("p_brand", 15, False, {"Brand#1": 1.0, "Brand#2": 0.25}, 4, "label"),
    ("p_type", 10, False, {"ECONOMY": 0.0, "SMALL": 1.0}, 5, "label"),
)
_CRIT_SQL = ", ".join(f"('{c}', {w}, {str(lo).lower()}, {o}, '{g}')" for c, w, lo, _, o, g in CRITERIA)
_SCORE_SQL = "CASE " + " ".join(f"WHEN criterion = '{c}' AND category = '{k}' THEN {v}::DOUBLE" for c, _, _, m, _, _ in CRITERIA for k, v in m.items()) + " ELSE 0.5::DOUBLE END"

VALUES = """
q AS (SELECT l_partkey, max(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey),
c AS (SELECT p_partkey AS id, p_size, p_retailprice, quantity, p_brand, p_type FROM part LEFT JOIN q ON p_partkey = l_partkey),
v AS (SELECT id, 'p_size' AS criterion, p_size::DOUBLE AS number, NULL::VARCHAR AS category FROM c
 UNION ALL SELECT id, 'p_retailprice', p_retailprice::DOUBLE, NULL FROM c UNION ALL SELECT id, 'quantity', quantity::DOUBLE, NULL FROM c
 UNION ALL SELECT id, 'p_brand', NULL, p_brand FROM c UNION ALL SELECT id, 'p_type', NULL, p_type FROM c),
b AS (SELECT criterion, count(*) AS total, count(coalesce(number::VARCHAR, category)) AS n, min(number) AS lo, max(number) AS hi, quantile_cont(number, 0.5) AS median, quantile_cont(number, 0.25) AS p25, quantile_cont(number, 0.75) AS p75, count(DISTINCT category) AS kinds FROM v GROUP BY criterion)"""
NORMS = f"""
k(criterion, weight, lower, ord, grp) AS (VALUES {_CRIT_SQL}),
m AS (SELECT v.id, v.criterion, weight, CASE WHEN category IS NOT NULL THEN {_SCORE_SQL} WHEN number IS NULL THEN NULL
  WHEN p75 = p25 THEN CASE WHEN number = p25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  WHEN lower THEN 1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, (number - p25) / (p75 - p25))) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (number - p25) / (p75 - p25))) END AS norm
  FROM (SELECT v.*, b.p25, b.p75, k.weight, k.lower FROM v JOIN b USING (criterion) JOIN k USING (criterion)) v)"""


def values(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("quantity"))
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    return p.long_form(part.join(q, F.col("p_partkey") == F.col("l_partkey"), "left"), "p_partkey", NUMERIC, CATEGORICAL)


def criteria(spark):
    return spark.createDataFrame([(c, w, lo, m) for c, w, lo, m, _, _ in CRITERIA], "criterion string, weight int, lower boolean, scores map<string,double>")


def norms(spark, d):
    v = values(spark, d)
    return p.normalised(v, p.baselines(v), criteria(spark))


@query("profile_baselines", f"WITH {VALUES} SELECT criterion, total, n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, kinds, round(n / total, 6) AS coverage, coalesce(hi > lo, kinds > 1) AS discriminating FROM b")
def profile_baselines(spark, d):
    b = p.baselines(values(spark, d))
    return b.withColumns({c: F.round(c, 6) for c in ("lo", "hi", "median", "p25", "p75", "coverage")})


@query("profile_histogram", f"WITH {VALUES} SELECT criterion, category, count(*) AS n FROM v WHERE category IS NOT NULL GROUP BY ALL")
def profile_histogram(spark, d):
    return p.histogram(values(spark, d))


@query("profile_overrides", f"WITH {VALUES} SELECT criterion, CASE WHEN criterion = 'p_size' THEN 20.0::DOUBLE ELSE round(p25, 6) END AS p25, CASE WHEN criterion = 'p_size' THEN 20.0::DOUBLE WHEN criterion = 'quantity' THEN 44.0::DOUBLE ELSE round(p75, 6) END AS p75 FROM b")
def profile_overrides(spark, d):
    points = spark.createDataFrame([("p_size", 20.0, 20.0), ("quantity", None, 44.0)], "criterion string, p25 double, p75 double")
    return p.overridden(p.baselines(values(spark, d)), points).select("criterion", F.round("p25", 6).alias("p25"), F.round("p75", 6).alias("p75"))


@query("profile_normalised", f"WITH {VALUES}, {NORMS} SELECT id, criterion, round(norm, 6) AS norm FROM m")
def profile_normalised(spark, d):
    return norms(spark, d).select("id", "criterion", F.round("norm", 6).alias("norm"))


@query("profile_composite", f"WITH {VALUES}, {NORMS} SELECT id, round(100 * sum(norm * weight) / sum(CASE WHEN norm IS NOT NULL THEN weight END), 6) AS score, round(coalesce(sum(CASE WHEN norm IS NOT NULL THEN weight END), 0) / sum(weight), 6) AS completeness, coalesce(array_to_string(list_sort(list(criterion) FILTER (norm IS NULL)), ','), '') AS missing FROM m GROUP BY id")
def profile_composite(spark, d):
    return p.composite(norms(spark, d)).select("id", F.round("score", 6).alias("score"), F.round("completeness", 6).alias("completeness"), F.array_join("missing", ",").alias("missing"))


@query("profile_drivers", f"WITH {VALUES}, {NORMS}, g AS (SELECT id, criterion, round(norm * weight, 6) AS gain FROM m WHERE norm * weight > 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, criterion)::INT AS rank FROM g) SELECT * FROM r WHERE rank <= 3")
def profile_drivers(spark, d):
    rounded = norms(spark, d).withColumns({"norm": F.round(F.col("norm") * F.col("weight"), 6), "weight": F.lit(1)})
    return p.drivers(rounded)


@query("profile_category_totals", f"WITH k(criterion, weight, lower, ord, grp) AS (VALUES {_CRIT_SQL}), g(grp) AS (VALUES ('shape'), ('trade'), ('label'), ('none')) SELECT g.grp, coalesce(sum(weight), 0)::BIGINT AS total FROM g LEFT JOIN k USING (grp) GROUP BY g.grp")
def profile_category_totals(spark, d):
    k = spark.createDataFrame([(g, w) for _, w, _, _, _, g in CRITERIA], "grp string, weight int")
    g = spark.createDataFrame([(x,) for x in ("shape", "trade", "label", "none")], "grp string")
    return g.join(k, "grp", "left").groupBy("grp").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))


@query("profile_effective_weights", f"WITH k(criterion, weight, lower, ord, grp) AS (VALUES {_CRIT_SQL}), x AS (SELECT *, weight * 100 / sum(weight) OVER () AS x FROM k WHERE criterion <> 'p_type'), f AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, ord) AS r FROM x) SELECT criterion, (f + CASE WHEN r <= 100 - sum(f) OVER () THEN 1 ELSE 0 END)::INT AS weight FROM f")
def profile_effective_weights(spark, d):
    k = spark.createDataFrame([(c, w, o) for c, w, _, _, o, _ in CRITERIA], "criterion string, weight int, ord int")
    return p.effective_weights(k, F.col("criterion") == "p_type")


@query("profile_weight_aliases", "SELECT * FROM (VALUES ('P-Size', 'p_size', 5, NULL), ('RETAIL price', 'p_retailprice', -1, 'negative'), ('colour', NULL, 3, 'unknown')) t(name, criterion, weight, problem)")
def profile_weight_aliases(spark, d):
    given = spark.createDataFrame([("P-Size", 5), ("RETAIL price", -1), ("colour", 3)], "name string, weight int")
    aliases = spark.createDataFrame([("psize", "p_size"), ("p_retailprice", "p_retailprice"), ("retail_price", "p_retailprice")], "alias string, criterion string")
    return p.weights_by_alias(given, aliases)


_MERGE = "coalesce(nullif(p_brand, 'Brand#1'), lower(p_name))"


@query("profile_merged_records", f"WITH r AS (SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'a' END AS source, {_MERGE} AS key FROM part), x AS (SELECT *, CASE WHEN p_size > 10 THEN p_size END AS sz FROM r) SELECT key, arg_min(sz, (source <> 'b', p_partkey)) AS sz, arg_min(p_retailprice, p_partkey) AS p_retailprice, count(*) AS records, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM x GROUP BY key")
def profile_merged_records(spark, d):
    r = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_retailprice", F.when(F.col("p_size") > 10, F.col("p_size")).alias("sz"), F.when(F.col("p_partkey") % 3 == 0, "b").otherwise("a").alias("source"))
    key = F.coalesce(F.nullif("p_brand", F.lit("Brand#1")), F.lower("p_name"))
    out = p.merged_records(r, key, F.col("p_partkey"), ["sz", "p_retailprice"], preferred=["sz"], prefer="b")
    return out.withColumn("sources", F.array_join("sources", ","))


@query("profile_best_potency", "SELECT l_partkey, min(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS best, count(*) AS n FROM lineitem GROUP BY l_partkey")
def profile_best_potency(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", F.when(F.col("l_returnflag") == "R", "nM").otherwise("uM").alias("units"))
    return p.best_potency(rows, "l_partkey", "l_extendedprice", "units")


@query("profile_universe", "SELECT p_partkey, p_size FROM part WHERE p_size >= 30 ORDER BY p_size DESC, p_partkey LIMIT 500")
def profile_universe(spark, d):
    return p.universe(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 30, 500)


_GATE_NAME = "(p_name || CASE WHEN p_partkey % 7 = 0 THEN ' insulin' WHEN p_partkey % 7 = 1 THEN ' abcdemab' ELSE '' END)"


@query("profile_structure_gate", f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no defined chemical structure' WHEN regexp_matches({_GATE_NAME}, 'insulin|mab$') THEN 'biologic, not a small molecule' WHEN p_retailprice > 1200 THEN 'molecular weight above the small-molecule range' END AS reason FROM part")
def profile_structure_gate(spark, d):
    n = F.col("p_partkey")
    name = F.concat("p_name", F.when(n % 7 == 0, " insulin").when(n % 7 == 1, " abcdemab").otherwise(""))
    smiles = F.when(n % 5 == 0, F.lit("")).otherwise("C")
    return table(spark, d, "part").select("p_partkey", labels.removal_reason(name, smiles, F.col("p_retailprice").cast("string")).alias("reason"))


_TREE = "below AS (SELECT 1 AS id UNION SELECT i FROM range(1, 51) t(i) WHERE i // 2 = 1 UNION SELECT i FROM range(1, 51) t(i) WHERE i // 4 = 1)"
_INDIC = "ind AS (SELECT DISTINCT l_partkey AS id, l_linenumber * 7 + l_suppkey % 7 AS disease FROM lineitem WHERE l_quantity > 48)"


@query("profile_exclusion", f"WITH {_TREE}, {_INDIC} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT ind.id FROM ind JOIN below ON disease = below.id)")
def profile_exclusion(spark, d):
    return _exclusion(spark, d)[0]


@query("profile_exclusion_audit", f"WITH {_TREE}, {_INDIC} SELECT ind.id, array_to_string(list_sort(list(DISTINCT disease)), ',') AS diseases FROM ind JOIN below ON disease = below.id JOIN part ON p_partkey = ind.id GROUP BY ind.id")
def profile_exclusion_audit(spark, d):
    return _exclusion(spark, d)[1].select("id", F.array_join("diseases", ",").alias("diseases"))


def _exclusion(spark, d):
    tree = spark.range(1, 51).select(F.col("id").alias("child"), F.floor(F.col("id") / 2).alias("parent"))
    diseases = p.descendants(tree, spark.range(1, 2), 2)
    ind = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") * 7 + F.col("l_suppkey") % 7).alias("disease")).distinct()
    return p.excluded(table(spark, d, "part").select(F.col("p_partkey").alias("id")), ind, diseases)


@query("profile_two_phase", "WITH h AS (SELECT p_partkey AS id, p_size::DOUBLE AS score FROM part), t AS (SELECT id FROM h ORDER BY score DESC, id LIMIT 60), g AS (SELECT l_partkey AS id, max(l_quantity)::DOUBLE AS gain FROM lineitem WHERE l_partkey IN (SELECT id FROM t) GROUP BY 1) SELECT h.id, score + coalesce(gain, 0) AS score, gain IS NOT NULL AS enriched FROM h LEFT JOIN g ON h.id = g.id ORDER BY 2 DESC, 1 LIMIT 25")
def profile_two_phase(spark, d):
    scores = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    gains = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_quantity").cast("double").alias("gain"))
    return p.two_phase(scores, gains, 60, 25)


_LABEL = "(CASE p_partkey % 6 WHEN 0 THEN 'Take one tablet twice daily.' WHEN 1 THEN 'Give 5 ml syrup every 8 hours; half-life of ' || p_size || ' to ' || (p_size + 3) || ' hours' WHEN 2 THEN 'Apply the patch weekly. Metabolised by CYP3A4 and CYP2D6' WHEN 3 THEN 'Absolute bioavailability is about ' || p_size || '% by CYP2C9' WHEN 4 THEN 'is not metabolized; infusion once daily' ELSE p_name END)"


@query("profile_label_fields", f"""WITH t AS (SELECT p_partkey, p_size, p_partkey % 6 AS k FROM part) SELECT p_partkey,
CASE k WHEN 0 THEN 'oral_solid' WHEN 1 THEN 'oral_liquid' WHEN 2 THEN 'transdermal' WHEN 4 THEN 'injection' END AS form,
CASE k WHEN 0 THEN 'twice_daily' WHEN 1 THEN 'three_times_daily' WHEN 2 THEN 'weekly_or_less' WHEN 4 THEN 'once_daily' END AS frequency,
CASE WHEN k = 3 AND p_size BETWEEN 1 AND 100 THEN p_size::DOUBLE END AS bioavailability, CASE WHEN k = 1 THEN p_size + 1.5::DOUBLE END AS half_life,
CASE k WHEN 2 THEN 'cyp3a4' WHEN 3 THEN 'single_non_3a4' WHEN 4 THEN 'none' END AS cyp FROM t""")
def profile_label_fields(spark, d):
    n, s = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = (
        F.when(n == 0, F.lit("Take one tablet twice daily."))
        .when(n == 1, F.concat(F.lit("Give 5 ml syrup every 8 hours; half-life of "), s, F.lit(" to "), (F.col("p_size") + 3).cast("string"), F.lit(" hours")))
        .when(n == 2, F.lit("Apply the patch weekly. Metabolised by CYP3A4 and CYP2D6"))
        .when(n == 3, F.concat(F.lit("Absolute bioavailability is about "), s, F.lit("% by CYP2C9")))
        .when(n == 4, F.lit("is not metabolized; infusion once daily"))
        .otherwise(F.col("p_name"))
    )
    t = table(spark, d, "part").select("p_partkey", text.alias("t"))
    t_ = F.col("t")
    return t.select("p_partkey", labels.dosage_form(t_).alias("form"), labels.dosing_frequency(t_).alias("frequency"), labels.bioavailability(t_).alias("bioavailability"), labels.half_life_hours(t_).alias("half_life"), labels.cyp_bucket(t_).alias("cyp"))


@query("profile_novelty_bands", "WITH c AS (SELECT l_partkey, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS a, nullif(count(*) FILTER (l_quantity > 40), 0) AS b FROM lineitem GROUP BY l_partkey), h AS (SELECT l_partkey, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END AS hits FROM c) SELECT l_partkey, hits, CASE WHEN hits IS NULL THEN 'Unknown' WHEN hits <= 0 THEN 'High' WHEN hits <= 10 THEN 'Moderate' WHEN hits <= 50 THEN 'Low' ELSE 'Well-explored' END AS band FROM h")
def profile_novelty_bands(spark, d):
    some = lambda c: F.nullif(F.count_if(c), F.lit(0))
    c = table(spark, d, "lineitem").groupBy("l_partkey").agg(some(F.col("l_returnflag") == "R").alias("a"), some(F.col("l_quantity") > 40).alias("b"))
    return c.select("l_partkey", labels.novelty_hits(F.col("a"), F.col("b")).alias("hits")).withColumn("band", labels.novelty_band(F.col("hits")))
