import random
import re
from collections import Counter, defaultdict

import pytest

from remedex.llm import op11_source_divergence as op
from remedex.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, item string, value int"


def brute(rows, least, shown):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for _, text, lang, source, *_ in rows]
    docs = [(a, b, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in t]) for a, b, t in docs]
    held, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        held[lang].update(set(terms))
    kept = {lang: sorted(w for w, k in c.items() if k >= least) for lang, c in held.items()}
    for lang, source, terms in docs:
        n[lang, source].update(w for w in terms if held[lang][w] >= least)
        n[lang].update(w for w in terms if held[lang][w] >= least)
    out = set()
    for lang, sources in groups.items():
        words = kept.get(lang, [])
        p = {k: [1 + 10**9 * (n[k][w] + 2) // (sum(n[k].values()) + 2 * len(words)) for w in words] for k in [lang, *((lang, s) for s in sources)]}
        for s in sources:
            pairs = [(sum((a - b) ** 2 // (a + b) for a, b in zip(p[lang, s], p[lang, o], strict=True)), o) for o in sources if o != s]
            terms = [((a - b) ** 2 // (a + b), w) for a, b, w in zip(p[lang, s], p[lang], words, strict=True) if n[lang, s][w] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, x, v, i) for i, (v, x) in enumerate(found, 1) if part == "pair" or i <= shown}
    return out


def got(spark, rows, **kw):
    df = op.audit(spark.createDataFrame(rows, SCHEMA), Scratch(spark), **kw)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(map(tuple, df.collect()))


def corpus(n, seed):
    r = random.Random(seed)
    words = ["The", "the", "élan", "ÉLAN", "naïve", "x1y", "a", "b", "Zeta", "zeta", "日本", "don't"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    return [(i if i % 11 else None, " \n,".join(r.choices(words, k=r.randint(0, 40))) if i % 13 else None, r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "S3", "ß", None]), "clash", i) for i in range(n)]


def test_equals_brute_force(spark):
    rows = corpus(300, 1)
    rows += rows[:20]  # repeated rows count again
    assert got(spark, rows, least=3, shown=5) == sorted(brute(rows, 3, 5))
    assert got(spark, rows) == sorted(brute(rows, 10, 10))


def test_small_chunks_and_one_hot_source(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 200)
    monkeypatch.setattr(op, "ROWS", 3)
    rows = corpus(120, 2) + [(i, "same words here " * 50, "en", "s1", "", 0) for i in range(100)]
    assert got(spark, rows, least=2, shown=3) == sorted(brute(rows, 2, 3))


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, None, None, None, None)],
        [(1, "alone", "en", "a", "", 0), (2, "alone", "en", "b", "", 0)],  # no kept term: pairs of value 0
        [(i, "tie toe" if i % 2 else None, "en", f"s{i % 3}", "", 0) for i in range(30)],
        [(i, "long " * 20000 + "tail", "en", f"s{i % 2}", "", 0) for i in range(12)],
    ],
)
def test_defined_cases(spark, rows):
    assert got(spark, rows) == sorted(brute(rows, 10, 10))
