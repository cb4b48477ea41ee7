import re
from collections import Counter

import pytest

from remedex.llm import op5_quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b", "a b a b a b", "x\ny\nx\n\n\n", "é ü\x0bß\x85  #|", "the cat of it " * 40, " ".join(f"w{i}" for i in range(200)), "the of and to " + " ".join(f"word{i}" for i in range(100)), "a b c d " * 400 + "z"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate([*TEXTS, *TEXTS[:3]])], "doc_id long, text string, n_words int")


def test_figures_equal_a_brute_force_count(docs):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in op.judge(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate([*TEXTS, *TEXTS[:3]])}


def test_verdicts_and_columns(docs):
    kept = op.apply_rules(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {10}
    assert {r.n_words for r in kept.collect()} == {7}


def test_a_filter_costs_no_more_than_the_query(docs):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    judged = op.judge(docs)
    whole, part = plan(judged), plan(judged.where("kept AND n_words > 3").select("doc_id", "n_repeat_words"))
    for name in ("split(", "xxhash64", "aggregate("):
        assert 0 < part.count(name) <= whole.count(name)
    assert {r.doc_id for r in judged.where("kept").collect()} == {10}


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a b c", 2, 3, 4, 5)], "doc_id long, text string, _w int, _f int, _row int, kept int")
    [r] = op.judge(df).collect()
    assert (r["_w"], r["_f"], r["_row"], r.kept, r.n_words) == (2, 3, 4, False, 3)
    assert op.apply_rules(df).columns == df.columns


def test_empty_table(spark, docs):
    assert op.judge(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(docs):
    assert "Python" not in op.judge(docs)._jdf.queryExecution().toString()
