import random
from collections import Counter

import numpy as np

from remedex.llm import op10_order_minhash as op
from remedex.llm.common import Scratch


def labelled(text, k=5):
    w = (text or "").encode().split()
    grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(rows):
    ids = sorted({i for i, _ in rows})
    text = dict(rows)
    gram = {i: labelled(text[i]) for i in ids}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and root(x) != root(y):
                a, b, k = (text[x] or "").split(), (text[y] or "").split(), len(set(gram[x]) & set(gram[y]))
                m = lcs(a, b) if k and k >= 0.5 * (len(gram[x]) + len(gram[y]) - k) else 0
                if (text[x] or "") == (text[y] or "") or m and m >= 0.8 * (len(a) + len(b) - m):
                    up[max(root(x), root(y))] = min(root(x), root(y))
    return {i: root(i) for i in ids}


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, passage = [], [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(r.choice([30, 120, 300]))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(r.choice([1, 2, 9])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, len(w) // 30])):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
        rows.append(" ".join(base[len(base) // 2 :] + base[: len(base) // 2]))
    return [(i * 3 % 1009, t) for i, t in enumerate([*rows, None, "", " \n", "one two", "one  two", "one three", "é " * 900, "é " * 901])]


def test_labels_and_alignment():
    h, at, words, word_at = op.kmers([b"a b c d e a b c d e a b c d e", b"", b"x y"])
    assert np.diff(at).tolist() == [11, 0, 1] and len(set(h.tolist())) == 12
    assert np.diff(word_at).tolist() == [15, 0, 2] and len(set(words.tolist())) == 7
    a = np.arange(100, dtype=np.uint64)
    assert len(op.chain(a, a[5:], 10)[0]) == 95 and len(op.chain(a, a[5:], 4)[0]) == 0
    r = random.Random(1)
    for _ in range(200):
        x, y = ([r.randrange(4) for _ in range(r.randrange(30))] for _ in range(2))
        assert op.common_words(np.array(x, dtype=np.uint64), np.array(y, dtype=np.uint64)) == lcs(x, y)
    for x, y in ((a, np.delete(a, [3, 50, 51])), (a, np.roll(a, 40)), (a, np.where(a % 11 == 5, 1000 + a, a)), (a, np.where(a % 7 == 5, 1000 + a, a))):
        m = lcs(x.tolist(), y.tolist())
        grams = [np.array([hash(tuple(v[i : i + 5])) & (1 << 63) - 1 for i in range(len(v) - 4)], dtype=np.uint64) for v in (x.tolist(), y.tolist())]
        assert op.aligned(*grams, x.astype(np.uint64), y.astype(np.uint64)) == (m >= 0.8 * (len(x) + len(y) - m))


def test_classes_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in [*rows, rows[0]]], "doc_id long, text string, size string")
    want = brute(rows)
    assert len(set(want.values())) < len(want)
    got = {r.doc_id: r.class_id for r in op.classes(df, Scratch(spark)).collect()}
    assert got == want
    monkeypatch.setattr(op, "BLOCK_ROWS", 3)
    assert {r.doc_id: r.class_id for r in op.classes(df, Scratch(spark)).collect()} == want
    kept = op.keep_one(df, Scratch(spark))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.classes(df, Scratch(spark)).count() == 0


def test_light_edits_are_found(spark):
    """Copies with up to one word in twenty replaced, dropped or added are in the class of their text; other texts are not."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, want = [], {}
    for g in range(150):
        base = [word() for _ in range(r.choice([60, 100, 400]))]
        rows.append((10 * g, " ".join(base)))
        for k, share in enumerate((0.01, 0.02, 0.03, 0.05), 1):
            w = list(base)
            for _ in range(round(share * len(w))):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1, 1])] = r.choice([[word()], [word()], []])
            rows.append((10 * g + k, " ".join(w)))
            want[10 * g + k] = 10 * g
    got = {x.doc_id: x.class_id for x in op.classes(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert all(got[i] // 10 == i // 10 for i in got)
    for k in (1, 2, 3, 4):
        caught = [got[i] == b for i, b in want.items() if i % 10 == k]
        assert sum(caught) >= (0.97 if k < 4 else 0.9) * len(caught), (k, sum(caught), len(caught))


def test_null_and_large_ids_and_clashing_columns(spark):
    big = 9007199254740993
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(big, text(1)), (big + 2, text(2)), (None, text(3)), (None, text(4)), (None, text(1)), (5, text(5)), (5, text(6)), (5, text(5)), (None, text(3)), (big + 4, text(2) + " more")]
    df = spark.createDataFrame([(i, t, k, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, same int, _id string, least int")
    kept = op.keep_one(df, Scratch(spark))
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([(str(big), text(1)), (str(big + 2), text(2)), ("None", text(3)), ("None", text(4)), ("5", text(5)), ("5", text(6))])
    got = op.classes(df, Scratch(spark)).collect()
    assert len(got) == 8 and sum(r.kept for r in got) == 6
    assert {(r.doc_id, r.class_id) for r in got} == {(big, big), (big + 2, big + 2), (big + 4, big + 2), (None, None), (None, big), (5, 5)}


def test_long_texts(spark):
    base = [f"w{i % 5000}" for i in range(60_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:30_000] + ["new"] * 5 + base[30_000:])), (3, " ".join(base[::-1]))]
    assert {r.doc_id: r.class_id for r in op.classes(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()} == {1: 1, 2: 1, 3: 3}
