"""The null model against a brute-force walk."""

import numpy as np
import pytest

from remedex.operators import graph
from remedex.operators.walks import converged


def brute(edges, seed, restart):
    nodes = sorted({a for a, _ in edges})
    w = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        w[nodes.index(b), nodes.index(a)] = 1 / sum(x == a for x, _ in edges)
    s = np.array([float(x == seed) for x in nodes])
    p = s
    for _ in range(100):
        p, last = (1 - restart) * w @ p + restart * s, p
        if np.abs(p - last).sum() < 1e-10:
            break
    return dict(zip(nodes, p))


def test_zscores_equal_brute_force(spark):
    line = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n2", "n7")]
    edges = [x for a, b in line for x in ((a, b), (b, a))] + [("s", "n1")]  # no drawn seed reaches s
    w = spark.createDataFrame([(a, b, 1 / sum(x == a for x, _ in edges)) for a, b in edges], "src string, dst string, w double")
    drawn = ["n0", "n5", "n9"]
    null = [brute(edges, d, 0.6) for d in drawn]
    got = {r.id: r for r in graph.null_zscore(w, "s", spark.createDataFrame([(d,) for d in drawn], "id string"), restart=0.6).collect()}
    want = brute(edges, "s", 0.6)
    assert set(got) == set(want)
    for i, p in want.items():
        at = np.array([x[i] for x in null])
        assert got[i].p == pytest.approx(p, abs=1e-9)
        assert got[i].z == pytest.approx((p - at.mean()) / max(at.std(), 1e-15), rel=1e-5)


def test_hubs_are_split_and_walks_kept_apart(spark):
    edges = [x for i in range(40) for x in (("hub", f"l{i}"), (f"l{i}", "hub"))] + [x for i in range(39) for x in ((f"l{i}", f"l{i + 1}"), (f"l{i + 1}", f"l{i}"))]
    w = spark.createDataFrame([(a, b, 1 / sum(x == a for x, _ in edges)) for a, b in edges], "src string, dst string, w double")
    seeds = spark.createDataFrame([("one", "hub", 1.0), ("two", "l7", 1.0), ("lost", "nowhere", 1.0)], "walk string, id string, p double")
    for hub in (7, 1 << 20):
        got = {(r.walk, r.id): r.p for r in converged(w, seeds, hub=hub).collect()}
        want = {("one", i): p for i, p in brute(edges, "hub", 0.3).items()} | {("two", i): p for i, p in brute(edges, "l7", 0.3).items()}
        assert set(got) == {*want, ("lost", "nowhere")} and got["lost", "nowhere"] == pytest.approx(0.3)
        assert all(got[k] == pytest.approx(p, abs=1e-9) for k, p in want.items())


def test_seeds_are_drawn_from_every_degree_quartile(spark):
    df = spark.createDataFrame([(f"d{i}", i) for i in range(200)], "id string, degree long")
    got = [int(r.id[1:]) for r in graph.degree_matched(df).collect()]
    assert len(got) == 100 and [sum(50 * q <= i < 50 * q + 50 for i in got) for q in range(4)] == [25] * 4
    assert graph.degree_matched(df.where("degree < 10")).count() == 10
