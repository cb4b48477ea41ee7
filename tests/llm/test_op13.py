import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from remedex.llm import op13_best_fit_packing as op
from remedex.llm.common import Scratch

PATH = public_tokenizers.path(op.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, row string, first string, ids int"


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, op.END]


def digest(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*"abZ09 \n\t\r.,'!<|>é\u00a0\u0085ßñ\u3000\u2003日ё", "'s", "  ", "\n\n", "<|endoftext|>", "don't"]), max_size=40).map("".join))
def test_chunks_have_the_ids_of_the_text(text):
    parts = op.chunks([text.encode(), b"x", text.encode()])
    assert b"".join(parts[0]) == text.encode() and parts[0] == parts[2]
    if "<|" not in text:
        assert b"".join(op.careful_chunks([text.encode()])[0]) == text.encode()
        assert [i for p in op.careful_chunks([text.encode()])[0] for i in LIBRARY.encode(p.decode(), add_special_tokens=False).ids] == LIBRARY.encode(text, add_special_tokens=False).ids
    assert [i for p in parts[0] for i in LIBRARY.encode(p.decode(), add_special_tokens=False).ids] == LIBRARY.encode(text, add_special_tokens=False).ids


def check(placed, docs, tokens, documents=None, cost=None):
    rows, bins, texts = defaultdict(list), defaultdict(list), defaultdict(list)
    for d, t, *_ in docs:
        texts[d].append(ids_of(t))
    for r in placed:
        rows[r["row"]].append(r)
        bins[r["sequence_id"]].append(r)
    assert len(rows) == len(docs)
    for found in rows.values():
        found.sort(key=lambda r: r["piece"])
        whole = next(x for x in texts[found[0]["doc_id"]] if len(x) == sum(r["length"] for r in found) and digest(x[: found[0]["length"]]) == found[0]["ids_crc32"])
        texts[found[0]["doc_id"]].remove(whole)
        at = 0
        for k, r in enumerate(found):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == digest(whole[at : at + r["length"]])
            assert r["length"] == tokens or (k == 0 and r["length"] == (len(whole) % tokens or tokens))
            at += r["length"]
    for found in bins.values():
        found.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in found] == np.cumsum([0, *(r["length"] for r in found)])[:-1].tolist()
        assert sum(r["length"] for r in found) <= tokens
        assert len(found) <= (documents or tokens) and sum(r["length"] ** 2 for r in found) <= (cost or tokens**2)
    return len(bins)


def corpus(n, seed, most=60):
    r = random.Random(seed)
    return [(i if i % 11 else None, " ".join(r.choices(["alpha", "Bêta,", "gamma.\n", "d'été", "<|endoftext|>"], k=r.randint(0, most))) if i % 13 else None, "clash", "", i) for i in range(n)]


@pytest.mark.parametrize("caps", [{}, {"documents": 3}, {"cost": 64 * 64}, {"documents": 2, "rule": "dot"}, {"rule": "dot"}])
def test_every_capacity_holds(spark, caps):
    docs = corpus(300, 1)
    docs += docs[:9] + [(5000, "long " * 3000, "", "", 0)]
    made = Scratch(spark).put(op.encoded(spark.createDataFrame(docs, SCHEMA), PATH, tokens=64), "made")
    placed = op.pieces(op.pack(made, 64, **caps), 64)
    n = check(placed.collect(), docs, 64, caps.get("documents"), caps.get("cost"))
    if not caps:
        total = sum(len(ids_of(t)) for _, t, *_ in docs)
        assert n <= 1.02 * -(-total // 64) + 1


def plain_best_fit(lengths, tokens, documents):
    """Best fit decreasing, one piece at a time, by the same norm."""
    capacity = np.array([tokens, documents, tokens * tokens])
    weights = np.array(op.WEIGHTS) / capacity.astype(float) ** 2
    left = np.zeros((0, 3), np.int64)
    for n in sorted(lengths, reverse=True):
        x = np.array([n, 1, n * n])
        fits = np.flatnonzero((left >= x).all(axis=1))
        if len(fits):
            i = fits[np.argmin(((left[fits] - x) ** 2) @ weights)]
            left[i] -= x
        else:
            left = np.vstack([left, capacity - x])
    return len(left)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_that_of_one_piece_at_a_time(seed):
    r = random.Random(seed)
    lengths = [min(127, int(r.expovariate(0.03)) + 1) for _ in range(800)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    for documents in (128, 4):
        plan = op.Plan(counts, 128, documents)
        assert abs(plan.bins - plain_best_fit(lengths, 128, documents)) <= 1
        bins, offset = plan.lookup(np.repeat(list(counts), list(counts.values())), np.concatenate([np.arange(n) for n in counts.values()]))
        used = np.zeros((plan.bins, 128), int)
        for n, b, o in zip(np.repeat(list(counts), list(counts.values())), bins, offset, strict=True):
            used[b, o : o + n] += 1
        assert used.max() == 1 and (used.sum(1) > 0).all()


def test_plan_does_not_grow_with_the_corpus():
    counts = {n: 100_000 - 50 * n for n in range(1, 1024)}
    few, many = op.Plan(counts), op.Plan({n: 1_000_000 * c for n, c in counts.items()})
    assert len(many.rows) < 1.5 * len(few.rows)
    total = sum(n * c for n, c in counts.items())
    assert few.bins <= 1.001 * total / 1024


def test_real_sequences(spark):
    docs = corpus(80, 2)
    out = op.packed_sequences(spark.createDataFrame(docs, SCHEMA), PATH, Scratch(spark), tokens=64).collect()
    texts = [ids_of(t) for _, t, *_ in docs]
    assert sorted(i for r in out for i in r["ids"]) == sorted(i for t in texts for i in t)
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 64 for r in out)


def test_empty_table_and_refused_capacities(spark):
    made = Scratch(spark).put(op.encoded(spark.createDataFrame([], SCHEMA), PATH), "made")
    assert op.pieces(op.pack(made)).collect() == []
    with pytest.raises(ValueError):
        op.Plan({}, 64, cost=64)
    with pytest.raises(ValueError):
        op.Plan({}, 64, rule="other")
