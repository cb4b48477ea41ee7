"""Bounded paths from both sides, and kept walk scores, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from remedex.operators import paths
from remedex.sources.scores import ScoreCache, graph_version

REGISTRY = {"a": 0.9, "b": 0.6, "c": 0.3}


def brute(edges, seed, targets, allowed, hops, most):
    near, out = {}, {}
    for s, t, r in edges:
        near.setdefault(s, []).append((t, REGISTRY.get(r, 0.0)))

    def go(nodes, weakest):
        for t, w in near.get(nodes[-1], []):
            if t not in nodes:
                if t in targets:
                    out.setdefault(t, []).append((len(nodes), -min(weakest, w), [*nodes, t]))
                if len(nodes) < hops and allowed(t):
                    go([*nodes, t], min(weakest, w))

    go([seed], 2.0)
    return {(t, tuple(n), -w, k, i) for t, found in out.items() for i, (k, w, n) in enumerate(sorted(found)[:most], 1)}


@pytest.mark.parametrize("seed, hops", [(1, 3), (2, 3), (3, 4), (4, 4), (5, 2), (6, 1)])
def test_same_as_all_simple_paths(spark, seed, hops):
    r = random.Random(seed)
    nodes = [f"{k}{i}" for k in "XYZ" for i in range(6)]
    pairs = {(a, b): r.choice("abcd") for a in nodes for b in nodes if a < b and r.random() < 0.35}
    edges = [(a, b, k) for (a, b), k in pairs.items()] + [(b, a, k) for (a, b), k in pairs.items()]
    targets = [n for n in nodes if n[0] in "XY"]
    df = spark.createDataFrame(edges, "src string, dst string, relation string")
    goal = spark.createDataFrame([(t,) for t in targets], "id string")
    for most in (5, 1):
        got = paths.best_paths(df, "X0", goal, lambda c: ~c.startswith("Z"), REGISTRY, hops, most).collect()
        want = brute(edges, "X0", set(targets) - {"X0"}, lambda n: n[0] != "Z", hops, most)
        assert {(x.target, tuple(x.nodes), x.min_confidence, x.hops, x.rank) for x in got} == want


def test_a_hub_hands_on_few_pieces(spark):
    """Three full layers: all simple paths would be 30 * 30 * 40, the pieces that meet are a fixed number for each middle node."""
    edges = [("s", f"a{i}", "a") for i in range(30)] + [(f"a{i}", f"b{j}", "abc"[j % 3]) for i in range(30) for j in range(30)] + [(f"b{j}", f"t{k}", "a") for j in range(30) for k in range(40)]
    e = paths.with_confidence(spark.createDataFrame(edges, "src string, dst string, relation string"), REGISTRY)
    left = paths.front(e, "s", lambda c: F.lit(True), 2, 5)
    assert left.count() == 30 * 7
    goal = spark.createDataFrame([(f"t{k}",) for k in range(40)], "id string")
    met = paths._joined(left, paths.back(e, goal, "s", lambda c: F.lit(True), 1, 5).withColumnRenamed("weakest", "_w"))
    assert met.count() == 30 * 7 * 40
    found = paths.best_paths(e.select("src", "dst", "relation"), "s", goal, lambda c: F.lit(True), REGISTRY)
    assert found.groupBy("target").count().where("count <> 5").isEmpty() and found.where("min_confidence < 0.9").isEmpty()


def test_hops_are_refused(spark):
    with pytest.raises(ValueError):
        paths.best_paths(spark.createDataFrame([], "src string, dst string, relation string"), "s", spark.createDataFrame([], "id string"), lambda c: F.lit(True), {}, 5)


def test_kept_scores_are_not_computed_again(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "a", "r")], "src string, dst string, relation string")
    version = graph_version(edges, restart=0.3)
    assert version == graph_version(edges.orderBy("dst"), restart=0.3) != graph_version(edges, restart=0.4)
    assert version != graph_version(edges.limit(1), restart=0.3)
    cache, asked = ScoreCache(spark, f"file://{tmp_path}/scores"), []

    def compute(seeds):
        asked.append(sorted(r.seed for r in seeds.collect()))
        return seeds.withColumn("p", F.col("p") / 2)

    assert {(r.seed, r.number) for r in cache.scores(version, ["a", "b"], compute).collect()} == {("a", 1), ("b", 1)}
    got = cache.scores(version, ["b", "c", "c"], compute)
    assert {(r.seed, r.id, r.p, r.number) for r in got.collect()} == {("b", "b", 0.5, 1), ("c", "c", 0.5, 2)}
    cache.scores(version, ["a", "b", "c"], compute)
    assert asked == [["a", "b"], ["c"]]
    assert {r.seed for r in cache.scores("other", ["a"], compute).collect()} == {"a"} and len(asked) == 3
    # A batch that was written but not committed is not read, and files of other batches are not in the scan.
    cache.batches.write(spark.createDataFrame([("a", "z", 9.0)], "seed string, id string, p double"))
    again = cache.scores(version, ["c"], compute)
    assert [(r.seed, r.id) for r in again.collect()] == [("c", "c")]
    scan = [x for x in again._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "PartitionFilters" in x and "batch" in x.split("PartitionFilters")[1]]
    assert scan
