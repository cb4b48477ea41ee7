"""Centrality of many graphs in frames, against counting all shortest paths."""

import random
from collections import deque

from remedex.operators.centrality import centrality, importance
from pyspark.sql import functions as F


def brute(links):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)

    def ways(s):
        far, n, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            a = todo.popleft()
            for b in near[a]:
                if b not in far:
                    far[b], n[b] = far[a] + 1, 0
                    todo.append(b)
                if far[b] == far[a] + 1:
                    n[b] += n[a]
        return far, n

    all_ = {s: ways(s) for s in near}
    k, out = len(near), {}
    for v in near:
        between = 0.0
        for s in near:
            far, n = all_[s]
            for t in far:
                if len({s, t, v}) == 3 and v in far and t in all_[v][0] and far[v] + all_[v][0][t] == far[t]:
                    between += n[v] * all_[v][1][t] / n[t]
        far = all_[v][0]
        total = sum(far.values())
        out[v] = (len(near[v]) / max(k - 1, 1), (len(far) - 1) / total * (len(far) - 1) / max(k - 1, 1) if total else 0.0, between / max((k - 1) * (k - 2), 1))
    return out


def graphs():
    r = random.Random(3)
    out = {"line": [(f"n{i}", f"n{i + 1}") for i in range(6)], "pair": [("a", "b")], "star": [("m", f"l{i}") for i in range(5)], "two": [("a", "b"), ("c", "d"), ("d", "e")]}
    for g in range(3):
        out[f"random{g}"] = [(f"v{a}", f"v{b}") for a in range(14) for b in range(a) if r.random() < 0.2]
    return {k: v + [(b, a) for a, b in v] for k, v in out.items()}


def test_equals_brute_force(spark):
    all_ = graphs()
    rows = [(g, a, b) for g, links in all_.items() for a, b in [*links, *links[:1], ("loop", "loop")]]
    got = {(x.graph, x.id): (x.degree, x.closeness, x.betweenness) for x in centrality(spark.createDataFrame(rows, "graph string, src string, dst string")).collect()}
    want = {(g, v): x for g, links in all_.items() for v, x in brute(links).items()}
    assert set(got) == set(want)
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_sampled_sources_are_scaled(spark):
    links = [("g", f"n{i}", f"n{(i + s) % 40}") for i in range(40) for s in (1, -1)]
    df = spark.createDataFrame(links, "graph string, src string, dst string")
    exact = {x.id: x.betweenness for x in centrality(df).collect()}
    some = {x.id: x.betweenness for x in centrality(df, sources=10).collect()}
    assert abs(sum(some.values()) - sum(exact.values())) < 1e-9 and some != exact


def test_importance_and_no_links(spark):
    df = spark.createDataFrame([("g", "m", "a"), ("g", "a", "m"), ("g", "m", "b"), ("g", "b", "m")], "graph string, src string, dst string")
    got = {x.id: x.importance for x in importance(df, lambda c: F.lit(0.5)).collect()}
    assert got["m"] == 1.0 and got["a"] == got["b"] < 1
    assert importance(df.limit(0), lambda c: F.lit(1.0)).count() == 0
