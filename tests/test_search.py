"""Searches, requests and landed JSON against literal fixtures; loose names against the library's own matcher."""

import json
import os
from difflib import get_close_matches

from pyspark.sql import functions as F

from remedex.functions import requests as rq
from remedex.operators import search as s
from remedex.sources import landed


def test_loose_names_agree_with_the_matcher(spark):
    names = ["asthma", "type 2 diabetes", "breast cancer", "acute myeloid leukaemia", "gout"]
    queries = ["Asthma", "breast-cancer", "ashtma", "gaut", "the gout of an old and otherwise quite healthy man", "xxxxxxxx", " "]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {r.query: (r.id, r.way) for r in s.loosely_named(df, queries).collect()}
    want = {}
    for q in queries:
        low = q.lower().strip()
        close = get_close_matches(low, names, n=1, cutoff=0.4)
        held = sorted(n for n in names if low and (low in n or n in low))
        if low.replace("-", " ") in names:
            want[q] = (names.index(low.replace("-", " ")), 0)
        elif close:
            want[q] = (names.index(close[0]), 1)
        elif held:
            want[q] = (names.index(held[0]), 2)
    assert got == want and {w for _, w in got.values()} == {0, 1, 2}


def test_capped_paths(spark):
    edges = [("d", x, "r") for x in "abc"] + [(x, "t", "q") for x in "abc"] + [("c", "u", "q"), ("d", "t", "z")]
    e = spark.createDataFrame([*edges, *[(b, a, r) for a, b, r in edges]], "src string, dst string, relation string")
    goal = spark.createDataFrame([("t",), ("u",)], "id string")
    weight = lambda c: F.when(c == "b", 3).when(c == "a", 2).otherwise(1)
    found = s.capped_paths(e, "d", goal, {"d": 2}, weight, lambda c: c, lambda c: c != "t")
    got = sorted((r.target, "".join(r.nodes), r.rank) for r in found.collect())
    assert got == [("t", "dat", 2), ("t", "dbt", 1), ("t", "dt", 3)]  # c is beyond the cap, and u with it
    assert s.capped_paths(e.limit(0), "d", goal, {}, weight, lambda c: c, lambda c: c != "t").count() == 0


def test_entities_of_questions(spark):
    rows = ["AMPK in obesity", "how does IL-6 cause chronic kidney disease", "type 1 diabetes", "", None, "what is the role"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "i int, q string")
    got = [tuple(r) for r in df.orderBy("i").select(rq.asked_target(F.col("q")), rq.asked_disease(F.col("q"))).collect()]
    assert got == [("AMPK", "obesity"), ("IL-6", "chronic kidney disease"), (None, "type 1 diabetes"), (None, None), (None, None), (None, None)]


def test_display_scores_and_statistics(spark):
    nodes = spark.createDataFrame([("g", "d", 0, 4.0), ("g", "a", 1, 2.0), ("g", "t", 3, 3.0), ("one", "x", 0, 7.0)], "graph string, id string, hop int, importance double")
    got = {r.id: r.importance for r in s.display_scores(nodes, spark.createDataFrame([("t",)], "id string"), lambda c: F.lit(0.5)).collect()}
    assert got == {"d": 100.0, "a": 0.0, "t": 47.44, "x": 0.0}
    links = spark.createDataFrame([("g", "d", "a"), ("g", "a", "t")], "graph string, src string, dst string")
    got = {r.graph: tuple(r)[1:] for r in s.graph_statistics(nodes, links).collect()}
    assert got == {"g": (3, 2, 1.33, 0.3333), "one": (1, 0, 0.0, 0.0)}


def test_manifests_newest_first(spark, tmp_path):
    for i, (name, text) in enumerate([("old", json.dumps({"run_id": "r1", "status": "done", "combinations": 2, "proteins": [{"protein_name": "p"}]})), ("new", '{\n "status": "running"\n}'), ("bad", "{")]):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "manifest.json").write_text(text)
        os.utime(tmp_path / name / "manifest.json", (1_000_000 + i, 1_000_000 + i))
    got = [(r.run_id, r.status, r.proteins) for r in landed.run_manifests(spark, str(tmp_path)).collect()]
    assert got == [("new", "running", None), ("r1", "done", ["p"])]


def test_written_again_and_flat(spark, tmp_path):
    df = spark.createDataFrame([(1, ("x", (2, [3])))], "a int, b struct<c: string, d: struct<e: int, f: array<int>>>")
    flat = landed.flattened(df)
    assert flat.columns == ["a", "b_c", "b_d_e", "b_d_f"] and tuple(flat.first()) == (1, "x", 2, [3])
    for _ in range(2):
        landed.append_json(flat, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    landed.overwrite_rows(flat, f"{tmp_path}/t")
    landed.overwrite_rows(flat.limit(0), f"{tmp_path}/t", flat.select(F.lit("none").alias("note")))
    assert spark.read.parquet(f"{tmp_path}/t").columns == ["note"]
