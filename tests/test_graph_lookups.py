"""Edges are looked up where they are read, and shuffled once where all are needed."""

from pyspark.sql import functions as F

from remedex.operators import graph as g
from remedex.sources.settle import stored

ROWS = [("C1", "r", "N3"), ("N3", "q", "C1"), ("S1", "r", "N3"), ("P1", "p", "S1"), ("P1", "p", "S1"), ("P2", "p", "S1"), ("P2", "x", "P2"), ("P3", None, "C1")]


def test_edges_of_few_nodes_are_found_before_they_are_made_unique(spark):
    t = stored(spark.createDataFrame(ROWS, "source string, edge_type string, target string"))
    few = stored(spark.createDataFrame([("S1",), ("C1",), ("none",)], "id string"))
    out = g.touching(g.symmetric(t), few)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("S1", "N3", "r"), ("S1", "P1", "p"), ("S1", "P2", "p"), ("C1", "N3", "r"), ("C1", "P3", None)], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Each direction is an aggregate of its own, over a semi join with the nodes.
    assert plan.index("Aggregate [a") < plan.index("LeftSemi")


def test_weights_need_one_shuffle(spark):
    t = stored(spark.createDataFrame(ROWS, "source string, edge_type string, target string"))
    kind = lambda c: F.substring(c, 1, 1)
    e = g.symmetric_by_source(t)
    assert sorted(map(tuple, e.collect()), key=repr) == sorted(map(tuple, g.symmetric(t).collect()), key=repr)
    w = g.layered_weights(e, kind)
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert {(r.src, r.dst): r.w for r in w.collect()} == {(r.src, r.dst): r.w for r in g.layered_weights(g.symmetric(t), kind).collect()}
    assert {(r.src, r.dst): r.w for r in w.collect()}[("N3", "S1")] == 0.5
