import math
import random
import re
from collections import Counter

import pytest

from remedex.llm import op12_lexical_search as op
from remedex.llm.common import Scratch

DOCS, ITEMS = "doc_id long, text string, term string, score int", "item_id long, text string, rank string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top=20):
    tf = [Counter(terms(t)) for _, t, *_ in docs]
    size = [sum(c.values()) for c in tf]
    n, length, df = sum(s > 0 for s in size), sum(size), Counter(w for c in tf for w in c)
    out = []
    for item_id, text in {(i, t) for i, t, *_ in items}:
        found = []
        for (doc_id, *_), c, s in zip(docs, tf, size, strict=True):
            if s:
                m = 75 + 25 * s * n // length
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
                if score > 0:
                    found.append((-score, doc_id is not None, doc_id or 0))
        out += [(item_id, i, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **kw):
    scratch = Scratch(spark)
    name, parts = op.index(spark.createDataFrame(docs, DOCS), scratch)
    df = op.search(spark, name, parts, spark.createDataFrame(items, ITEMS), scratch, **kw)
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(n, seed):
    r = random.Random(seed)
    words = ["The", "the", "of", "élan", "Élan", "naïve", "x1y", "42", "don't"] + [f"w{i}" for i in range(300)]
    weights = [400, 400, 300] + [5] * 6 + [300 / (i + 1) for i in range(300)]
    text = lambda k: " ,\n".join(r.choices(words, weights, k=k))
    docs = [(i if i % 17 else None, text(r.randint(0, 60)) if i % 13 else None, "clash", i) for i in range(n)]
    return docs, [(i, text(r.randint(1, 30)), "clash") for i in range(12)]


@pytest.mark.parametrize("opened, chunk, part", [(op.OPEN, op.CHUNK, op.PART), (30, 2000, 50), (0, 300, 7)])
def test_equals_brute_force(spark, monkeypatch, opened, chunk, part):
    monkeypatch.setattr(op, "OPEN", opened)
    monkeypatch.setattr(op, "CHUNK", chunk)
    monkeypatch.setattr(op, "PART", part)
    monkeypatch.setattr(op, "ROWS", 5)
    monkeypatch.setattr(op, "TRIED", 25)
    docs, items = corpus(400, 3)
    docs += docs[:5]  # repeated rows rank apart
    items += items[:1] + [(items[0][0], "w1 w2", ""), (None, "w3", ""), (77, None, ""), (78, "nowhere", ""), (79, ",;", "")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, items, top=3) == brute(docs, items, 3)


def test_ties_and_a_word_of_every_document(spark, monkeypatch):
    monkeypatch.setattr(op, "PART", 50)
    docs = [(i, "same words everywhere" if i % 3 else "same " * 5 + f"w{i % 5}", "", 0) for i in range(300, 0, -1)]
    items = [(1, "same words same w1", ""), (2, "everywhere", "")]
    assert got(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a", "")]), ([(1, "a", "", 0)], []), ([(1, None, "", 0)], [(1, "a", "")]), ([(1, "a " * 30000 + "b", "", 0), (2, "b", "", 0)], [(5, "b a", "")])])
def test_defined_cases(spark, docs, items):
    assert got(spark, docs, items) == brute(docs, items)


def test_postings_are_read_as_they_lie(spark):
    """The join of item terms moves the items only, and the sums leave most postings of common words out."""
    scratch = Scratch(spark)
    docs, items = corpus(200, 5)
    name, parts = op.index(spark.createDataFrame(docs, DOCS), scratch)
    asked = op.item_terms(spark.createDataFrame(items, ITEMS)).selectExpr("explode(terms) term").distinct().selectExpr("term", "explode(sequence(0, 0)) part")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.table(name).join(asked, ["term", "part"])
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    own = plan[: plan.index("FileScan parquet spark_catalog")].splitlines()
    join = max(i for i, x in enumerate(own) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in own[join:])
