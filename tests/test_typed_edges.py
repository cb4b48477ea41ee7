"""Weights with one pass over the edges; searches that leave out the scans of other layers."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from remedex.operators import graph as g
from remedex.operators import search as s
from remedex.plans import graph as base
from remedex.sources.settle import stored

SF = "/root/testdata/sf0.001"
KIND = lambda c: F.substring(c, 1, 1)
ROWS = [("C1", "r", "N3"), ("N3", "q", "C1"), ("S1", "r", "N3"), ("P1", "p", "S1"), ("P1", "p", "S1"), ("P2", "p", "S1"), ("P2", "x", "P2"), ("P3", None, "C1"), ("P1", "x", "P3"), ("P3", "y", "P1"), (None, "r", "P1"), ("Q1", "r", "Q2")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_weights_are_counted_in_one_pass(spark):
    plan = entry.queries()["kg_layer_weights"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # before, the edges were made unique twice and joined with their counts
    t = stored(spark.createDataFrame(ROWS, "source string, edge_type string, target string"))
    assert rows(g.weights_by_source(t, KIND)) == rows(g.layered_weights(g.symmetric(t), KIND))
    assert g.weights_by_source(t.limit(0), KIND).count() == 0


def typed(triples):
    return triples.withColumns({"source_kind": KIND(F.col("source")), "target_kind": KIND(F.col("target"))})


def scans(plan):
    """How often an optimized plan reads each table of the graph."""
    first = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "part": "p_partkey"}
    return {t: n for t, c in first.items() if (n := plan.count(f"Relation [{c}"))}


def test_kinds_leave_out_scans(spark):
    e = base.typed_edges(spark, SF)
    assert rows(e.select("src", "dst", "relation")) == rows(base.edges(spark, SF))
    assert e.where("ks <> substr(src, 1, 1) OR kd <> substr(dst, 1, 1)").count() == 0
    seeds = stored(spark.createDataFrame([("S1",), ("R1",)], "id string"))
    plan = g.leaving(e, seeds, KIND)._jdf.queryExecution().optimizedPlan().toString()
    assert scans(plan) == {"lineitem": 1, "supplier": 1, "nation": 1}  # before, all six sources once for each direction
    t = stored(spark.createDataFrame(ROWS, "source string, edge_type string, target string"))
    assert rows(g.symmetric(typed(t)).drop("ks", "kd")) == rows(g.symmetric(t))
    tree = lambda e: rows(g.capped_bfs(e, "N3", {"N": 2, "S": 1}, lambda c: F.lit(1), KIND, 3))
    assert tree(g.symmetric(typed(t))) == tree(g.symmetric(t)) and len(tree(g.symmetric(t))) > 3


def test_all_parts_with_edges_share_context(spark, tmp_path):
    """As the SQL has it, also parts that the table of parts does not have."""
    for t in ("nation", "region", "customer", "supplier", "orders", "lineitem", "part"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.where("p_partkey % 2 = 0") if t == "part" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    q = entry.queries()["target_shared_context"]
    assert rows(q(spark, f"{tmp_path}")) == rows(q(spark, SF)) != []


def test_capped_paths_by_kind(spark):
    goal = spark.read.parquet(f"{SF}/part.parquet").select(F.concat(F.lit("P"), "p_partkey").alias("id"))
    found = lambda e, goal, closed: rows(s.capped_paths(e, "S1", goal, {"S": 9, "P": 3}, base.bfs_weight, KIND, lambda c: ~KIND(c).isin(*closed)).select("target", "nodes", "relations", "rank"))
    for closed in (("C", "O"), ("C",)):
        assert found(base.typed_edges(spark, SF), goal, closed) == found(base.edges(spark, SF), goal, closed) != []
    assert found(base.typed_edges(spark, SF), goal.limit(0), ("C",)) == []


def test_paths_by_kind(spark):
    """Random graphs of four kinds, with edges within a kind, and goals that may be closed kinds themselves."""
    rnd = random.Random(3)
    names = [k + str(i) for k in "ABCD" for i in range(4)]
    for pairs, goals, closed in ((("AB", "BC", "CD", "BB"), "D", "C"), (("AB", "BC", "CD", "BB"), "D", "A"), (("AA", "AB", "CB"), "BC", "B"), (("AB", "CD"), "D", "")):
        edges = [(a, "r", b) for a in names for b in names if a[0] + b[0] in pairs and rnd.random() < 0.6]
        t = stored(spark.createDataFrame(edges, "source string, edge_type string, target string"))
        goal = stored(spark.createDataFrame([(n,) for n in names if n[0] in goals], "id string"))
        allowed = lambda c: ~KIND(c).isin(list(closed))  # noqa: B023, E731
        for hops in (1, 3):
            steps = g.kind_steps(pairs, "A", goals, closed, hops)
            got = g.paths(g.symmetric(typed(t)), "A1", goal, allowed, hops, steps, list(goals))
            assert rows(got) == rows(g.paths(g.symmetric(t), "A1", goal, allowed, hops))


def test_hops_that_cannot_meet_a_goal_are_left_out(spark):
    assert g.kind_steps(base.PAIRS, "N", ["P"], base.CLOSED, 3) == [(["N"], ["S"]), (["S"], ["P"]), ([], [])]
    for name in ("kg_sourcing_gate", "kg_subgraph_links"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert scans(plan) == {"lineitem": 1, "part": 1}
