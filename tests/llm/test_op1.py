import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from remedex.llm import op1_lm_scoring as op
from remedex.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = object()


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), END]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in split(t))
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(split(t)), sum(count[w] > 0 for w in split(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows}


ROWS = [(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 30)) + (" Élan ÉLAN\x0bA\x85b Rare%d" % i)) for i in range(60)] + [(100, None), (101, ""), (102, "x " * 3000)]


@pytest.fixture
def scored(spark):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in ROWS], "doc_id long, text string, score double")
    return {r.doc_id: r for r in op.lm_scores(df, Scratch(spark)).collect()}


def test_base_and_counts_equal_brute_force(scored):
    want = brute(ROWS)
    assert set(scored) == set(want)
    for i, w in want.items():
        r = scored[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_salted_hot_words_and_many_buckets_keep_base_scores(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_TOKENS", 50)
    monkeypatch.setattr(op, "BYTES_PER_BUCKET", 500)
    monkeypatch.setattr(op, "TOKENS_PER_CHUNK", 40)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: r for r in op.lm_scores(df, Scratch(spark)).collect()}
    again = {r.doc_id: r.score for r in op.lm_scores(df.repartition(3), Scratch(spark)).collect()}
    for i, w in brute(ROWS).items():
        assert got[i].base_score == pytest.approx(w[4], rel=1e-9) and got[i].n_known == w[2]
        assert again[i] == pytest.approx(got[i].score, rel=1e-9)


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=30))
def test_packed_numbers_come_back(values):
    x = np.array(values, dtype=np.uint64)
    assert op.unpack(op.pack(x)).tolist() == values
    assert op.unpack_sorted(op.pack_sorted(np.sort(x))).tolist() == sorted(values)


def test_seating_follows_the_chinese_restaurant(spark):
    rng = np.random.default_rng(5)
    a, d, c, n = 0.7, 0.4, 12, 20000
    fast = op.seat(np.full(n, c), np.full(n, a), d, rng)
    t = np.ones(n)
    for k in range(1, c):
        t += rng.random(n) < a / (k - d * t + a)
    assert abs(fast.mean() - t.mean()) < 0.03 and abs(fast.std() - t.std()) < 0.03
    assert op.seat(np.array([0, 1]), np.array([1.0, 1.0]), 0.5, rng).tolist() == [0, 1]


def test_better_than_the_base_on_held_out_documents(spark):
    r = op.perplexity(op.query(spark, "/root/testdata/sf0.001")).first()
    assert r.model < 0.5 * r.base


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.lm_scores(df, Scratch(spark)).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = op.lm_scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string"), Scratch(spark)).collect()
    assert len(rows) == 2 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


def test_null_ids_and_very_long_texts(spark):
    rows = [(None, "a b"), (None, None), (1, "word " * 300_000), (2, "x" * 400_000)]
    got = {r.doc_id: r for r in op.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {None: 4, 1: 300_001, 2: 2} and not got[None].held_out
