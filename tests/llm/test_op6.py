import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from remedex.llm import op6_token_orc as op

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World's 123!!", None, "", " \t\n", "a\x85b\xa0c é İI ΑΣ ΑΣ.", "x<|endoftext|>y <|startoftext|> <|endoftext|>", "日本語 текст " * 30, "w" * 3000, "Ça va\x0bbien\x0cmerci 👍🏽 don't"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]


def test_marks_apart_give_the_same_ids(plain):
    r = random.Random(3)
    bits = ["a", "B", "don't", "'s", "***", ".", ",", "!!", "é", "…", "5", " ", " ", "\n", "_", "&", "\x01", "ß", "I\u0307", "'", "\x85"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(400)]
    encode = op.word_encoder(PATH)
    for t, words in zip(texts, op.loosen([t.encode() for t in texts]), strict=True):
        assert [*(encode(words)[0].tolist() if words else []), 2] == plain(t), t


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_ids_equal_the_tokenizer_on_whole_texts(spark, plain):
    df = spark.createDataFrame([(i, t, [0]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    assert {r.doc_id: r.ids for r in op.encode(df, PATH).collect()} == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_files_are_in_order_and_prunable(spark, plain, tmp_path):
    n = 300
    df = spark.createDataFrame([(i * 7 % n - 5, TEXTS[i % len(TEXTS)]) for i in range(n)] + [(0, "twice"), (0, "twice")], "doc_id long, text string").repartition(5)
    op.write(df, f"file://{tmp_path}/o", PATH)
    back = op.read(spark, f"file://{tmp_path}/o")
    want = sorted((r.doc_id, plain(r.text)) for r in df.collect())
    assert sorted((r.doc_id, r.ids) for r in back.collect()) == want
    bounds = sorted((r[1], r[2]) for r in back.groupBy("file").agg({"doc_id": "min"}).join(back.groupBy("file").agg({"doc_id": "max"}), "file").collect())
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op.starts(op.digests(back)).collect())
    at = 0
    for g in got:
        assert g[1] == at
        at += g[2]
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted((d, len(i), crc(i)) for d, i in want)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    op.write(df, f"file://{tmp_path}/o", PATH)
    assert op.starts(op.digests(op.read(spark, f"file://{tmp_path}/o"))).count() == 0
