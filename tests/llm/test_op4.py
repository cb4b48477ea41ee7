import numpy as np
import pytest

from remedex.llm import op4_source_mixing as op
from remedex.llm.common import Scratch


def brute_targets(sizes, total):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: op.WEIGHTS[i % 3] for i, s in enumerate(names)}
    open_, left, out = set(names), float(total), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / w > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * left / w for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10, "é": 5, None: 40, "z": 0}, {"x": 7}, {"a": 1, "b": 100000}, {f"s{i}": (i * 7919) % 1000 for i in range(20)}])
def test_targets_equal_round_by_round_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in op.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes, sum(sizes.values())))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(n):
    a = op.permuted(np.arange(n), n, 3, 1)
    assert sorted(a) == list(range(n))
    assert n < 64 or (a != op.permuted(np.arange(n), n, 3, 2)).any()


@pytest.fixture
def docs(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 400)), f"s{i % 3 if i % 2 else 0}", "clash") for i in range(400)]
    rows += [(400, None, "s1", "c"), (401, "a b", None, "c"), (401, "a b", None, "c"), (402, "", "s2", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mix_meets_targets_and_caps(spark, docs):
    rows = op.taken(*op.mix(docs, Scratch(spark))).collect()
    assert len(rows) == docs.count()
    assert rows and sorted(rows) == sorted(op.taken(*op.mix(docs.repartition(3), Scratch(spark))).collect())
    source = {(r.doc_id): r.source for r in docs.collect()}
    total: dict = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        s = total.setdefault(source[r.doc_id], [0, r.target])
        s[0] += r.taken
    for n, t in total.values():
        assert abs(n - t) <= max(64, 0.02 * t)


def test_documents_of_the_mix_have_the_taken_words(spark, docs):
    docs = docs.select("doc_id", "text", "source", "size", docs.text.isNull().cast("long").alias("n_chars"))
    want: dict = {}
    for r in op.taken(*op.mix(docs, Scratch(spark))).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    made = op.mixed_documents(docs, Scratch(spark))
    assert made.columns == docs.columns
    got: dict = {}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in made.collect():
        w = r.text.split()
        assert set(w) <= set(text[r.doc_id].split()) and r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(w)
    assert got == {k: v for k, v in want.items() if v}


def test_empty(spark, docs):
    assert op.taken(*op.mix(docs.limit(0), Scratch(spark))).count() == 0


def test_shards_hold_their_draws(spark):
    import pandas as pd

    plan = pd.DataFrame({"source_size": [64 * 5000, 64 * 2000, 64 * 900], "target": [64 * 3000.0, 64 * 3000.0, 64 * 1900.0], "number": [0, 1, 2]})
    slots = op.block_counts(spark, plan)
    got = {(r.shard, r.number): r.n for r in op.shard_sizes(slots).collect()}
    total = sum(got.values())
    assert total == 7900 and slots.groupBy("number", "turn", "block").count().where("count > 1").isEmpty()
    per = {}
    for (shard, _), n in got.items():
        per[shard] = per.get(shard, 0) + n
    assert max(per.values()) <= op.SHARD
    shares = np.array([3000, 3000, 1900]) / 7900
    for shard in (0, 1):
        drawn = op.draws(shard, min(op.SHARD, 7900 - shard * op.SHARD), shares)
        assert all(got.get((shard, k), 0) <= drawn[k] for k in range(3))


def test_null_and_large_ids_and_clashing_columns(spark):
    big = 9007199254740993
    rows = [(i, " ".join(f"w{k}_{j}" for j in range(40 + k)), f"s{k % 3}", k, None, "x", 7) for k, i in enumerate([big, big + 2, None, None, 5, 5, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tie int, parts int, row string, n_chars long")
    got = op.taken(*op.mix(df, Scratch(spark), block=8), block=8).collect()
    assert len(got) == 7 and all(r.taken > 0 for r in got if r.target >= r.source_size)
    assert {r.doc_id for r in got} == {big, big + 2, None, 5}
    target = {r.source_size: r.target for r in got}
    sums: dict = {}
    for r in got:
        sums[r.source_size] = sums.get(r.source_size, 0) + r.taken
    assert all(abs(sums[k] - target[k]) <= 16 for k in target)
    made = op.mixed_documents(df, Scratch(spark), block=8)
    assert made.columns == df.columns
    words: dict = {}
    for r in made.collect():
        assert (r.doc_id, r.tie) in {(x[0], x[3]) for x in rows} and (r.parts, r.row) == (None, "x")
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    want: dict = {}
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in want.items() if v}
