"""Every previous word is a context of its own, whatever their number."""

import zlib

import numpy as np

from remedex.llm import op1_lm_scoring as op
from remedex.llm.common import Scratch

HELD = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2]
TRAIN = [i for i in range(4000) if i not in set(HELD)]


def test_words_that_shared_a_hashed_context_are_told_apart(spark):
    u, v = "w17on", "w23on"  # words of one ending
    rows = [(i, f"{u} red" if i % 2 else f"{v} blue") for i in TRAIN[:400]]
    rows += list(zip(HELD, [f"{u} red", f"{u} blue", f"{v} blue", f"{v} red"]))
    got = {r.doc_id: r.score for r in op.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    right, wrong, right2, wrong2 = (got[i] for i in HELD[:4])
    assert right > wrong + 0.7 and right2 > wrong2 + 0.7  # five times as likely


def test_contexts_grow_with_the_vocabulary(spark):
    rows = [(i, " ".join(f"{i}_{k}" for k in range(1000))) for i in TRAIN[:80]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "false AS held")
    deal = op.Deal(5, np.zeros(0, np.uint64), 1)
    names = [op.unpack_sorted(r.names) for r in op.counts(df, deal).select("names").collect()]
    assert len(np.unique(np.concatenate(names))) == 80 * 1000 + 1


def test_probabilities_of_a_context_sum_to_one(spark):
    """A held-out document has every word after one context, so the cells of this context cover the vocabulary."""
    words = [f"t{k}" for k in range(40)]
    rows = [(i, " ".join(words[(i * k * k + k) % 37] for k in range(30))) for i in TRAIN[:50]] + [(HELD[0], " ".join(f"t1 {w}" for w in words) + " t1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", f"doc_id = {HELD[0]} AS held")
    [h] = op.pairs([b"t1"])[0][op.pairs([b"t1"])[0] != op.END]
    for hot in (np.zeros(0, np.uint64), np.sort(op.pairs([b"t1 t2 t3"])[0])):
        deal = op.Deal(3, hot, 4)
        scratch = Scratch(spark)
        cells = scratch.put(op.counts(df, deal), "cells")
        home = scratch.put(op.at_home(cells, deal.buckets), "home")
        state, totals = op.trained(cells, home, scratch, deal, 1)
        g = totals[-1]
        assert g["train"] == 50 * 31 and g["v"] == 38 and len(totals) == op.SWEEPS - op.BURN
        samples = {r.bucket: [op.numbers(t) for t in r.samples] for r in state.collect()}
        back = op.answers(home, op.asked(cells.select("bucket", "names"), deal.buckets, 2, op._no_values).unionByName(op.asked(state, deal.buckets, 1, op._sample_values)), len(totals)).collect()
        seen, new, tables = 0.0, 0.0, np.zeros(len(totals))
        for r in cells.collect():
            x = op.Cells(r)
            replies = op.Replies(x.names, deal.buckets)
            for y in back:
                if y.bucket == x.bucket:
                    replies.add(y.home, y.x)
            p = op.averaged(x, samples[x.bucket], replies.x, totals, deal)
            own = x.names[x.context] == h
            known = x.per_word(x.c) if x.bucket < deal.buckets else g["hot"][1][np.searchsorted(deal.hot, x.words)]
            lives = known[x.word] > 0
            seen += p[own & lives].sum()
            new = max(new, *p[own & ~lives], 0)
            for k, t in enumerate(samples[x.bucket]):
                tables[k] += t.sum() + (x.c == 1).sum()
        assert abs(seen + new - 1) < 1e-9 and new > 0
        assert tables.tolist() == [t["n"] for t in totals]
