"""Names are found whatever their number of words, and similar names whatever letters changed."""

import random
from difflib import SequenceMatcher

from remedex.operators import resolve


def test_fuzzy_finds_every_name_of_the_ratio(spark):
    words = ["asthma", "myopia", "croup", "abd", "acne", "gout", "lung", "a", "", "diabetes mellitus"]
    asked = ["ashtma", "mypoia", "corup", "abcd", "ance", "goat", "LUNGS", "b", "diabetse melitus"]
    names = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    got = {(r.query, r.name, r.ratio) for r in resolve.fuzzy(spark.createDataFrame([(q,) for q in asked], "query string"), names).collect()}
    all_ = ((q, w, SequenceMatcher(None, q.lower(), w.lower()).ratio()) for q in asked for w in words)
    assert got == {x for x in all_ if x[2] >= 0.75}
    assert {"ashtma", "mypoia", "corup", "abcd", "ance", "goat"} <= {q for q, _, _ in got}


def test_a_thousand_queries_meet_few_names(spark):
    """The rows of brute force, and pairs that are few against all names of fitting lengths."""
    r = random.Random(5)
    part = ["al", "be", "cy", "do", "er", "fi", "go", "hu", "in", "ju", "ka", "lo", "mi", "no", "or"]
    words = sorted({" ".join("".join(r.choices(part, k=r.randint(2, 4))) for _ in range(r.randint(1, 3))) for _ in range(600)})
    asked = []
    for _ in range(1000):
        w = list(r.choice(words))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice("abcxyz ")
        asked.append("".join(w))
    names = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    want, fitting = set(), 0
    for q in set(asked):
        rows = []
        for w in words:
            if 2 * min(len(q), len(w)) >= 0.75 * (len(q) + len(w)):
                fitting += 1
                m = SequenceMatcher(None, q, w)
                if m.quick_ratio() >= 0.75 and m.ratio() >= 0.75:
                    rows.append((-m.ratio(), w))
        want |= {(q, w, -x) for x, w in sorted(rows)[:5]}
    assert {(x.query, x.name, x.ratio) for x in resolve.fuzzy(queries, names).collect()} == want
    assert resolve.name_pairs(queries, names, 0.75).count() < 0.1 * fitting


def test_low_ratios(spark):
    words = ["asthma", "myopia", "gout", "lung cancer", "ab", "", "zzz"]
    asked = ["asthmatic", "cancer", "b", "", "qqq"]
    names = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    got = {(x.query, x.name) for x in resolve.fuzzy(spark.createDataFrame([(q,) for q in asked], "query string"), names, least=0.3).collect()}
    assert got == {(q, w) for q in asked for w in words if SequenceMatcher(None, q, w).ratio() >= 0.3}


def test_contained_names_of_any_number_of_words(spark):
    names = [(k, " ".join(f"n{k}x{i}" for i in range(k))) for k in range(2, 42)]
    texts = [(k, f"seen {name} here") for k, name in names] + [(99, "nothing here"), (100, f"{names[0][1]}, {names[30][1]}")]
    got = resolve.contained(spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(names, "id long, name string")).collect()
    assert {r.doc: (r.id, r.name) for r in got} == {k: (k, name) for k, name in names} | {100: names[30]}
