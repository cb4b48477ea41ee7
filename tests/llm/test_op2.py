import hashlib
import random

import numpy as np
import pytest

from remedex.llm import op2_suffix_dedup as op
from remedex.llm.common import Scratch


def brute(rows):
    seen, out = set(), {}
    for doc, t in sorted(dict(rows).items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40), text(25), "ab" * 90, " " * 150]
    rows = []
    for i in range(90):
        parts = [text(r.randrange(30))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 3 + 1)
            parts += [p[a : len(p) - r.randrange(20)], text(r.randrange(12))]
        rows.append((i * 7 % 97, r.choice(["", " "]).join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(0, 90, 9)]
    for k in range(5):
        w = rows[k * 3][1].split(" ")
        w[len(w) // 2] = word()
        rows.append((300 + k, " ".join(w)))
    return [*rows, (400, None), (401, ""), (402, "x" * 99), (403, "x" * 100), (404, "x" * 500), (405, "x" * 499)]


def result(df, spark):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.removal(df, Scratch(spark)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    assert result(df, spark) == brute(rows)


def test_hot_grams_and_small_buffers(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    monkeypatch.setattr(op, "HOT", 2)
    monkeypatch.setattr(op, "STRINGS", 200)
    assert result(df, spark) == want


def test_deep_shallow_groups():
    r = np.random.default_rng(2)
    base = r.integers(0, 3, 400).astype(np.uint8)
    buf = np.concatenate([base, base, base[:150], r.integers(0, 2, 300).astype(np.uint8), np.zeros(130, np.uint8), np.full(120, 255, np.uint8)])
    starts = np.arange(len(buf) - 100)
    got = op.equal_suffixes(buf, starts, np.zeros(len(starts), int))
    first: dict = {}
    want = [first.setdefault(buf[s : s + 100].tobytes(), s) for s in starts]
    assert got.tolist() == want


def test_repeated_rows_empty_table_and_documents(spark):
    t = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(5, t, 1), (5, t, 1), (9, "new " + t, 2), (9, "new " + t, 2), (10, t, 3), (11, None, None)], "doc_id long, text string, n_chars long")
    rows = sorted((r.doc_id, r.n_removed) for r in op.removal(df, Scratch(spark)).collect())
    n = len(t)
    assert rows == [(5, 0), (5, 0), (9, n), (9, n), (10, n), (11, 0)]
    cut = op.cut_documents(df, Scratch(spark))
    assert cut.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=str) == sorted([(10, "", 0), (11, None, None), (5, t, 1), (5, t, 1), (9, "new ", 4), (9, "new ", 4)], key=str)
    assert op.removal(df.limit(0), Scratch(spark)).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.query(spark, d).collect()}
    assert got == brute(rows)


def test_null_ids_and_differing_texts_of_an_id(spark):
    t = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(None, t), (None, t), (3, "x " + t), (4, t * 3), (4, t), (5, t * 3)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_bytes): r.n_removed for r in op.removal(df, Scratch(spark)).collect()}
    n = len(t)
    assert rows[None, n] == 0 and rows[3, n + 2] == n and rows[4, n] == n and rows[5, 3 * n] == 3 * n


def test_very_common_passage_over_many_tasks(spark):
    r = random.Random(5)
    p = " ".join(f"pass{i}" for i in range(80))
    rows = [(i, f"{r.random()} {p[r.randrange(3):]} {r.random()}" if i % 3 else f"own {i} " * 9) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(df, spark) == brute(rows)
