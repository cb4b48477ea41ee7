"""Queries of the application and screening operators, and of name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedex.functions import text as t
from remedex.operators import app, resolve
from remedex.operators import screening as s
from remedex.plans import query
from remedex.sources.tables import table
from remedex.sources.triples import merged_values, placed

# ---------------------------------------------------------------- screening: suppliers as proteins, parts as ligands


def _logs(spark, d):
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_suppkey").alias("protein"), F.col("l_partkey").alias("ligand"), (-F.col("l_extendedprice")).alias("affinity"), "l_orderkey", "l_linenumber")


_BEST = "bp AS (SELECT * FROM (SELECT l_suppkey AS protein, l_partkey AS ligand, -l_extendedprice AS affinity, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY -l_extendedprice, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1)"


@query("screen_best_poses", f"WITH {_BEST} SELECT protein, ligand, affinity, l_orderkey, l_linenumber FROM bp")
def screen_best_poses(spark, d):
    return s.best_poses(_logs(spark, d), ["protein", "ligand"], "affinity", ["l_orderkey", "l_linenumber"])


@query("screen_top_fraction", f"WITH {_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY affinity, ligand)::INT AS rank, count(*) OVER (PARTITION BY protein) AS c FROM bp) SELECT protein, ligand, affinity, rank FROM r WHERE rank <= greatest(floor(c * 0.05), 1)")
def screen_top_fraction(spark, d):
    best = screen_best_poses(spark, d)
    return s.top_fraction(best, "affinity", ["ligand"], 0.05, per="protein").select("protein", "ligand", "affinity", "rank")


@query("screen_saved_members", f"WITH {_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY affinity, ligand) AS rank, count(*) OVER (PARTITION BY protein) AS c FROM bp), t AS (SELECT protein, ligand, affinity FROM r WHERE rank <= greatest(floor(c * 0.05), 1)) SELECT count(*) AS n, count(DISTINCT ligand) AS ligands FROM (SELECT l_suppkey AS protein, l_partkey AS ligand, -l_extendedprice AS affinity FROM lineitem) x WHERE (protein, ligand, affinity) IN (SELECT * FROM t)")
def screen_saved_members(spark, d):
    hit = _logs(spark, d).join(screen_top_fraction(spark, d), ["protein", "ligand", "affinity"], "left_semi")
    return hit.agg(F.count("*").alias("n"), F.count_distinct("ligand").alias("ligands"))


@query("screen_log_rows", "SELECT l_orderkey, l_linenumber, l_linenumber AS mode, -(l_suppkey % 90) / 10.0::DOUBLE - 0.5::DOUBLE AS affinity FROM lineitem WHERE l_returnflag <> 'N'")
def screen_log_rows(spark, d):
    n = F.format_string("%4d  %8.1f   0.000   0.000", F.col("l_linenumber"), -(F.col("l_suppkey") % 90) / 10.0 - 0.5)
    text = F.when(F.col("l_returnflag") != "N", n).otherwise(F.lit("-----+------------+----------"))
    return s.log_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("value")))


@query("screen_boxes", "SELECT l_suppkey, round((min(l_quantity) + max(l_quantity)) / 2, 3) AS centre_x, round(greatest(20.0::DOUBLE, least(40.0::DOUBLE, max(l_quantity) - min(l_quantity) + 16)), 3) AS size_x, round((min(l_linenumber) + max(l_linenumber)) / 2, 3) AS centre_y, round(greatest(20.0::DOUBLE, least(40.0::DOUBLE, max(l_linenumber) - min(l_linenumber) + 16)), 3) AS size_y, 0.0::DOUBLE AS centre_z, 20.0::DOUBLE AS size_z FROM lineitem GROUP BY l_suppkey")
def screen_boxes(spark, d):
    atoms = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return s.box(atoms, "l_suppkey")


@query("screen_interactions", "WITH l AS (SELECT l_suppkey, 'hbond' AS flag FROM lineitem WHERE l_quantity > 25 UNION ALL SELECT l_suppkey, 'stack' FROM lineitem WHERE l_discount > 0.05) SELECT l_suppkey, flag, count(*) AS n FROM l GROUP BY ALL")
def screen_interactions(spark, d):
    wide = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") > 25).alias("hbond"), (F.col("l_discount") > 0.05).alias("stack"))
    return s.melted(wide, ["l_suppkey"], ["hbond", "stack"]).groupBy("l_suppkey", "flag").agg(F.count("*").alias("n"))


@query("screen_best_hit", "SELECT l_suppkey AS protein, min_by(l_partkey, (-l_extendedprice, l_partkey)) AS ligand, min(-l_extendedprice) AS affinity FROM lineitem GROUP BY l_suppkey")
def screen_best_hit(spark, d):
    return s.best_poses(_logs(spark, d).select("protein", "ligand", "affinity"), ["protein"], "affinity", ["ligand"])


@query("screen_status_split", "WITH r AS (SELECT l_suppkey AS protein, l_orderkey * 10 + l_linenumber AS ligand, l_returnflag = 'R' AS failed, -l_extendedprice AS a FROM lineitem) SELECT protein, ligand, failed, CASE WHEN NOT failed THEN row_number() OVER (PARTITION BY protein, failed ORDER BY a, ligand)::INT END AS rank FROM r")
def screen_status_split(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("protein"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ligand"), F.when(F.col("l_returnflag") == "R", "Failed[timeout]").otherwise("ok").alias("status"), (-F.col("l_extendedprice")).alias("affinity"))
    return s.status_split(rows, "status", "affinity").select("protein", "ligand", "failed", "rank")


@query("screen_batch", "WITH b AS (SELECT l_suppkey AS protein, min_by(l_partkey, (-l_extendedprice, l_partkey)) AS ligand, min(-l_extendedprice) AS affinity FROM lineitem GROUP BY l_suppkey), p AS (SELECT protein FROM b ORDER BY affinity, protein LIMIT 10), l AS (SELECT ligand, min(affinity) AS a FROM b GROUP BY ligand ORDER BY a, ligand LIMIT 20) SELECT protein, ligand FROM p, l")
def screen_batch(spark, d):
    """The 10 proteins with the best hits against the 20 best ligands: all that the guard of the batch allows."""
    best = screen_best_hit(spark, d)
    proteins = best.orderBy("affinity", "protein").limit(10).select("protein")
    ligands = best.groupBy("ligand").agg(F.min("affinity").alias("a")).orderBy("a", "ligand").limit(20).select("ligand")
    return s.batch(proteins, ligands)


# ---------------------------------------------------------------- application lists and states


@query("app_paged_list", "WITH x AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderstatus = 'F') SELECT o_orderkey, o_orderpriority, o_totalprice, (SELECT count(*) FROM x) AS total, ceil((SELECT count(*) FROM x) / 25)::BIGINT AS pages FROM x ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25")
def app_paged_list(spark, d):
    rows = app.searched(table(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_orderpriority"], "HIGH").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return app.page(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, 25)


@query("app_sessions_with_steps", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)")
def app_sessions_with_steps(spark, d):
    steps = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return app.with_children(table(spark, d, "orders").select("o_orderkey", "o_custkey"), steps, "o_orderkey")


@query("app_json_roll_up", "SELECT event_type, sum(coalesce((props::JSON ->> '$.k')::DOUBLE, 0)) AS total, count(*) AS n FROM events GROUP BY event_type")
def app_json_roll_up(spark, d):
    return app.json_sum(table(spark, d, "events"), "event_type", "props", "$.k")


@query("app_progress", "SELECT o_orderkey, CASE status WHEN 'purchase' THEN 100 WHEN 'error' THEN 0 ELSE o_orderkey % 100 END AS percent FROM orders LEFT JOIN (SELECT event_id, event_type AS status FROM events) ON o_orderkey = event_id")
def app_progress(spark, d):
    items = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("percent"))
    jobs = table(spark, d, "events").select(F.col("event_id").alias("o_orderkey"), F.col("event_type").alias("status"))
    return app.progress(items, jobs, "o_orderkey", {"purchase": 100, "error": 0}).select("o_orderkey", F.col("percent").cast("bigint").alias("percent"))


@query("app_latest_per_branch", "SELECT l_suppkey AS session, l_returnflag AS branch, max(l_orderkey * 10 + l_linenumber) AS index FROM lineitem GROUP BY ALL")
def app_latest_per_branch(spark, d):
    steps = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_returnflag").alias("branch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"))
    return app.latest(steps, ["session", "branch"], ["index"])


_STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query("app_job_states", f"WITH g AS (SELECT user_id AS job, {_STATE} AS status, ts FROM events), o AS (SELECT *, list_position(['queued', 'running', 'completed', 'failed'], status) AS o FROM g), l AS (SELECT job, arg_max(status, (ts, o)) AS status, max(ts) AS ts, count(*) AS changes FROM o GROUP BY job) SELECT job, CASE WHEN status IN ('queued', 'running') AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'failed' ELSE status END AS status, changes FROM l")
def app_job_states(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running").when(kind == "purchase", "completed").otherwise("failed")
    end = e.agg(F.max("ts")).first()[0]
    return app.job_states(e.select(F.col("user_id").alias("job"), status.alias("status"), "ts"), F.col("ts") < F.lit(end) - F.expr("INTERVAL 1 DAY")).select("job", "status", "changes")


@query("app_trail", "SELECT conv_id, md5(string_agg(text, '|' ORDER BY turn, text)) AS digest, count(*) AS n FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id")
def app_trail(spark, d):
    out = app.trail(table(spark, d, "conversations"), "conv_id", "turn", (F.col("role") == "assistant") & F.col("text").isNotNull(), "text")
    return out.select("conv_id", F.md5(F.array_join("trail", "|")).alias("digest"), F.size("trail").cast("bigint").alias("n"))


@query("app_merged_state", "SELECT user_id AS session, 'k' || (event_id % 3) AS key, arg_max(value, (ts, event_type)) AS value FROM events WHERE (event_type = 'view' AND event_id % 3 < 2) OR (event_type = 'click' AND event_id % 3 = 2) GROUP BY ALL")
def app_merged_state(spark, d):
    out = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("agent"), "ts", F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("key"), "value")
    return app.merged_state(out, "session", {"view": ["k0", "k1"], "click": ["k2"]})


@query("app_usage", "SELECT coalesce(event_type, 'TOTAL') AS kind, count(*) AS calls, sum(event_id)::BIGINT AS tokens FROM events GROUP BY ROLLUP (event_type)")
def app_usage(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("tokens"), F.col("value").alias("cost"))
    return app.usage(calls).select("kind", "calls", "tokens")


@query("app_upsert", "WITH s AS (SELECT l_partkey, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS q FROM lineitem GROUP BY 1) SELECT p_partkey AS id, coalesce(q, p_size) AS v FROM part LEFT JOIN s ON p_partkey = l_partkey UNION ALL SELECT l_partkey, q FROM s WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def app_upsert(spark, d):
    target = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("v"))
    source = placed(table(spark, d, "lineitem")).select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("v"), "l_orderkey", "l_linenumber", "place")
    return merged_values(target, source, "id", "v", ["l_orderkey", "l_linenumber", "place"])


# ---------------------------------------------------------------- names


def _names(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("resolve_exact_forms", "WITH q AS (SELECT DISTINCT upper(replace(p_name, ' ', '-')) AS query, p_name AS n FROM part) SELECT query, (SELECT min(p_partkey) FROM part WHERE p_name = n) AS id, 2 AS rank FROM q")
def resolve_exact_forms(spark, d):
    q = _names(spark, d).select(F.upper(F.replace("name", F.lit(" "), F.lit("-"))).alias("query")).distinct()
    return resolve.resolved(q, _names(spark, d))


@query("resolve_last_by_form", "SELECT p_name AS form, max(p_partkey) AS id FROM part GROUP BY p_name")
def resolve_last_by_form(spark, d):
    return resolve.last_by_form(_names(spark, d).withColumn("ord", F.col("id")))


@query("resolve_token_subset", "WITH q(query, w) AS (VALUES ('the red', 'red'), ('small', 'small'), ('blue', 'blue')), m AS (SELECT query, p_name, p_partkey FROM q, part WHERE list_contains(string_split(p_name, ' '), w)) SELECT query, arg_min(p_partkey, (length(p_name), p_name, p_partkey)) AS id, 0.5::DOUBLE AS coverage FROM m GROUP BY query")
def resolve_token_subset(spark, d):
    q = spark.createDataFrame([("the red",), ("small",), ("blue",)], "query string")
    return resolve.by_tokens(q, _names(spark, d), stop=("the",))


@query("resolve_contained", "WITH g AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name), h AS (SELECT o_orderkey AS doc, 'order of ' || p_name || ', soon' AS text FROM orders JOIN part ON o_orderkey % 97 = p_partkey) SELECT doc, id, p_name AS name FROM h JOIN g ON contains(text, ' ' || p_name || ',')")
def resolve_contained(spark, d):
    names = _names(spark, d).groupBy("name").agg(F.min("id").alias("id"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 97).alias("id"))
    texts = o.join(_names(spark, d), "id").select("doc", F.concat(F.lit("order of "), "name", F.lit(", soon")).alias("text"))
    return resolve.contained(texts, names)


@query("resolve_fuzzy")
def resolve_fuzzy(spark, d):
    """Misspelt names against all names by matching blocks; SQL has no such ratio."""
    q = spark.createDataFrame([("smal ring",), ("bleu bolt",), ("red wigdet",)], "query string")
    return resolve.fuzzy(q, _names(spark, d).groupBy("name").agg(F.min("id").alias("id")).select("id", "name")).select("query", "id", "name", F.round("ratio", 6).alias("ratio"), "rank")


@query("resolve_shortlist", "WITH m AS (SELECT p_name AS name, p_partkey AS id, p_size > 25 AS e FROM part), x AS (SELECT *, bool_or(e) OVER (PARTITION BY name) AS any_e FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n, count(*) OVER (PARTITION BY name) AS c FROM x WHERE e = any_e) SELECT name, CASE WHEN max(c) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, max(c) AS matches, array_to_string(list_sort(list(id)), ',') AS choices FROM k WHERE n <= 5 GROUP BY name UNION ALL SELECT 'nothing', 'unresolved', 0, ''")
def resolve_shortlist(spark, d):
    part = table(spark, d, "part")
    structures = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), (F.col("p_size") > 25).alias("experimental"))
    requests = structures.select("name").unionByName(spark.createDataFrame([("nothing",)], "name string"))
    return resolve.shortlist(requests, structures).withColumn("choices", F.array_join("choices", ","))


@query("resolve_gene_and_route", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'JAK2' WHEN 1 THEN 'TP53' ELSE '' END AS gene, CASE p_partkey % 3 WHEN 0 THEN 'screen' WHEN 1 THEN 'novelty' ELSE 'targets' END AS module, CASE p_partkey % 3 WHEN 0 THEN 'dock JAK2' WHEN 1 THEN 'patents on tp53' ELSE p_name END AS target, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE '' END AS disease FROM part")
def resolve_gene_and_route(spark, d):
    n = F.col("p_partkey") % 3
    q = F.when(n == 0, F.concat(F.lit("dock JAK2 in "), "p_name")).when(n == 1, F.lit("patents on tp53")).otherwise(F.col("p_name"))
    x = table(spark, d, "part").select("p_partkey", q.alias("q"))
    cut = t.target_and_disease(F.col("q"))
    route = t.routed(F.col("q"), {"screen": "screen"}, {"screen": ("dock", "pose"), "novelty": ("patent", "novel")}, "targets")
    return x.select("p_partkey", t.gene_symbol(F.col("q")).alias("gene"), route.alias("module"), cut["target"].alias("target"), cut["disease"].alias("disease"))
