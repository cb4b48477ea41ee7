import numpy as np

from remedex.llm import op7_embedding_dedup as op
from remedex.llm.common import Scratch
from remedex.llm.components import components


def brute(rows, cosine=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(ok)
    links = {i: set() for i, _ in rows}
    for a in range(len(ids)):
        for b in range(a):
            x, y = ok[ids[a]], ok[ids[b]]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[ids[a]].add(ids[b])
                links[ids[b]].add(ids[a])
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in out:
                    out[k] = (len(links[k]), i)
                    todo += links[k]
    return out


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 7), (3, 9), (200, 1), (200, 2), (1, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 3, 9: 3, 7: 3, 3: 3, 200: 1, 1: 1, 2: 1}


def test_small_cases(spark):
    base = [1.0, 2.0, -1.0, 0.5]
    rows = [(3, base), (1, [2 * x for x in base]), (2, base), (4, None), (5, [0.0] * 4), (6, [1.0, None, 1.0, 1.0]), (7, [float("nan"), 1.0, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0, 1.0]), (9, base[:3]), (10, [-x for x in base]), (11, []), (12, [-0.0, 0.0, 0.0, 3.0]), (13, [0.0, -0.0, 0.0, 3.0]), (14, [1e30, 0.0, 0.0, 3.0]), (15, [5.0]), (16, [7.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.near_duplicates(df, Scratch(spark)).collect()}
    assert got == brute(rows)
    assert op.near_duplicates(df.limit(0), Scratch(spark)).count() == 0


def test_large_cells_are_split(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[0] + 0.1 * rng.standard_normal(8)).astype("f4").tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.near_duplicates(df, Scratch(spark)).collect()}
    monkeypatch.setattr(op, "CELL", 16)
    assert got == {r.vec_id: (r.n_links, r.component_id) for r in op.near_duplicates(df, Scratch(spark)).collect()}
    want = brute(rows)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)


def test_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.query(spark, d).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)


def test_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.1], [0.0, 1.0, 0.01, 0.1]
    big = 9007199254740993
    rows = [(None, a), (None, [1.0, 0.0, 0.01, 0.1]), (None, b), (big, c), (big + 2, b), (None, None), (7, None), (None, [0.0, 0.0, 1.0, 0.0]), (8, [0.0, -1.0, 0.0, 0.0]), (8, [0.0, -1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rep int")
    got = sorted(map(tuple, op.near_duplicates(df, Scratch(spark)).collect()), key=repr)
    want = [(None, 1, None, True), (None, 1, None, True), (None, 2, big, False), (big, 2, big, True), (big + 2, 2, big, False), (None, 0, None, True), (7, 0, 7, True), (None, 0, None, True), (8, 1, 8, True), (8, 1, 8, True)]
    assert got == sorted(want, key=repr)
