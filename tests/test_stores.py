"""Statements that are unique over all writes, caches, and the index of vectors."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from remedex.sources.caches import KeyedCache
from remedex.sources.statements import StatementTable
from remedex.sources.vectors import VectorStore, codebook


def test_statements_are_written_once(spark, tmp_path):
    schema = "source string, edge_type string, target string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    t = StatementTable(spark, f"file://{tmp_path}/s", schema, folders=4)
    first = rows(("a", "r", "b"), ("a", "r", "b"), ("a", None, "c"), (None, None, None), ("", None, "c"))
    assert t.write(first) == 4 and t.write(first) == 0
    assert t.write(rows(("a", "r", "b"), ("a", "r", "d"), ("a", None, "c"))) == 1
    t.batches.write(t._placed(rows(("x", "x", "x"))))  # a run that failed before its commit
    assert t.write(rows(("x", "x", "x"))) == 1
    again = StatementTable(spark, f"file://{tmp_path}/s", schema, folders=4)
    assert sorted(map(tuple, again.read().collect()), key=repr) == sorted([("a", "r", "b"), ("a", None, "c"), (None, None, None), ("", None, "c"), ("a", "r", "d"), ("x", "x", "x")], key=repr)
    assert t.write(rows()) == 0


def test_cache_expires_and_evicts(spark, tmp_path):
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    rows = lambda *x: spark.createDataFrame(list(x), "key string, value string")
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "key string")
    c = KeyedCache(spark, f"file://{tmp_path}/c", days=3, most=3)
    assert c.get(keys("a"), day(1)).collect() == []
    c.put(rows(("a", "1"), ("b", "2")), day(1, 9))
    c.put(rows(("c", "3"), ("a", "1b"), ("a", "1a")), day(2))
    # a was made anew, so b is the least recently used until it is asked for.
    assert {tuple(r) for r in c.get(keys("b", "zz"), day(3)).collect()} == {("b", "2")}
    c.put(rows(("d", "4")), day(4))
    assert {r.key for r in c.state().collect()} == {"a", "b", "d"}
    assert [r.key for r in c.last_used(2).collect()] == ["d", "b"]
    assert {r.key for r in c.get(keys("b", "d"), day(4, 23)).collect()} == {"b", "d"}
    # b is of the first: three days after it is still fresh, on the fourth day not, though it was used since.
    assert {r.key for r in c.get(keys("a", "b", "c", "d"), day(5)).collect()} <= {"a", "c", "d"}
    assert c.batches.manifest().count() == 1
    unlimited = KeyedCache(spark, f"file://{tmp_path}/u")
    unlimited.put(rows(*[(str(i), "v") for i in range(20)]), day(1))
    assert unlimited.get(keys(*map(str, range(30))), day(28)).count() == 20


def selected(df):
    """The number of folders that a scan reads."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numPartitions").value()


def vectors(n, d=8, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, d))
    return [(f"p{i % 10}-{i}", f"p{i % 10}", ["claims", "abstract"][i % 2], (centres[i % 12] + 0.4 * r.standard_normal(d)).tolist(), f"text {i}", i) for i in range(n)]


SCHEMA = "id string, owner string, section string, vector array<double>, payload string, added long"


def exact(rows, q, top, weight=lambda r: 1.0, where=lambda r: True):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    scored = sorted((-round(float(unit(r[3]) @ unit(q)) * weight(r), 9), r[0]) for r in rows if where(r))
    return [(i, -s) for s, i in scored[:top]]


def test_vector_index(spark, tmp_path):
    rows = vectors(600)
    df = spark.createDataFrame(rows, SCHEMA)
    store = VectorStore(spark, f"file://{tmp_path}/v", codebook(df, 16))
    store.upsert(df)
    r = random.Random(2)
    asked = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(15)]
    queries = spark.createDataFrame([*asked, (98, None), (99, [0.0] * 8)], "query int, vector array<double>")

    def found(**kw):
        out = {}
        for x in sorted(store.search(queries, 5, **kw).collect(), key=lambda x: x["rank"]):
            out.setdefault(x["query"], []).append((x["id"], round(x["score"], 9)))
        return out

    assert found() == {k: exact(rows, q, 5) for k, q in asked}
    assert found(probes=1) == found(probes=16)
    weighted = found(weight=F.when(F.col("section") == "claims", 1.0).otherwise(0.7), where=F.col("owner") != "p3")
    assert weighted == {k: exact(rows, q, 5, lambda x: 1.0 if x[2] == "claims" else 0.7, lambda x: x[1] != "p3") for k, q in asked}
    # Few cells are read for one query, and their folders are the only ones in the scan.
    cell = store.cells().first()["cell"]
    assert selected(store.rows([cell])) == 1 and selected(store.rows()) == store.cells().count()
    # Rows of known ids are replaced, wherever they lie now; other cells keep their batch.
    before = {x["cell"]: x["batch"] for x in store.cells().collect()}
    new = [(rows[0][0], "p0", "claims", [-x for x in rows[0][3]], "new", 1000), ("fresh", "p11", "claims", rows[5][3], "fresh", 1001), ("none", "p11", "x", None, "", 1), ("zero", "p11", "x", [0.0] * 8, "", 1)]
    touched = store.upsert(spark.createDataFrame(new, SCHEMA))
    after = {x["cell"]: x["batch"] for x in store.cells().collect()}
    assert {c for c in after if after[c] != before.get(c)} <= set(touched) and len(touched) <= 3
    rows = [new[0], *rows[1:], new[1]]
    assert store.rows().count() == 601 and found() == {k: exact(rows, q, 5) for k, q in asked}
    # The owners whose first row came first go; one that comes again is the newest.
    assert store.evict(8) == ["p3", "p2", "p1"]
    left = {x.owner for x in store.rows().select("owner").distinct().collect()}
    assert len(left) == 8 and "p11" in left
    rows = [x for x in rows if x[1] in left]
    assert found() == {k: exact(rows, q, 5) for k, q in asked}
    back = [("p1-again", "p1", "claims", asked[0][1], "back", 2000)]
    store.upsert(spark.createDataFrame(back, SCHEMA))
    assert len(store.evict(8)) == 1 and "p1" in {x.owner for x in store.rows().select("owner").distinct().collect()}
    assert found()[0][0] == ("p1-again", 1.0)
    store.delete(F.lit(True))
    assert store.rows().count() == 0 and found() == {}


def test_empty_store(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/v", np.eye(3))
    assert store.upsert(spark.createDataFrame([], SCHEMA)) == [] and store.evict(2) == []
    assert store.search(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query int, vector array<double>"), 3).count() == 0


def test_scores_of_a_block():
    from remedex.sources.vectors import best_of
    import pandas as pd

    r = np.random.default_rng(3)
    rows = r.standard_normal((300, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[[5, 77, 130, 299]] = rows[5]  # copies have one score and rank by id
    ids, weight = np.array([f"v{i}" for i in range(300)], dtype=object), r.choice([0.5, 1.0], 300)
    weight[[5, 77, 130, 299]] = 1.0
    q = np.vstack([r.standard_normal((3, 8)), rows[5]])
    floor = np.array([-np.inf, 1.0, np.inf, -np.inf])
    got = best_of(pd.Series([1, 2, 3, 4]), floor, q, ids, rows, weight, 6)
    for k, f, v in zip((1, 2, 3, 4), floor, q):
        want = sorted(((-sum_of(v * x) * w, i) for i, x, w in zip(ids, rows, weight)))[:6]
        assert [(-s, i) for s, i in zip(got[got["query"] == k]["score"], got[got["query"] == k]["id"])] == [(s, i) for s, i in want if -s >= f]
    assert list(got[got["query"] == 4]["id"])[:4] == ["v130", "v299", "v5", "v77"]


def sum_of(terms):
    out = 0.0
    for x in terms:
        out += x
    return out
