import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from remedex.llm import op9_byte_bpe as op

PATH = public_tokenizers.path(op.RANKS)
RANKS = op.load_ranks(PATH)
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TABLES = op.Tables(RANKS)
TEXTS = [None, "", "Hello world's  test\n\n x", "naïve Ünïcödé 日本語 текст 👍🏽", "aaaaaaaaaaaaaaaaaaaaaaa" * 9, "ab" * 900, " " * 3000, "<|endoftext|> \x85\xa0"]


@given(st.lists(st.one_of(st.binary(min_size=1, max_size=24), st.text("aeinrst", min_size=1, max_size=20).map(str.encode)), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_pieces_equal_the_library(pieces):
    flat, sizes = TABLES.encoded(pieces)
    want = [PLAIN._encode_single_piece(p) for p in pieces]
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


@given(st.lists(st.one_of(st.binary(min_size=1, max_size=24), st.text("aeinrst", min_size=1, max_size=60).map(str.encode), st.text(" a\n", min_size=1, max_size=40).map(str.encode)), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_long_pieces_equal_the_library(pieces):
    long = op.LONG
    try:
        op.LONG = 2
        flat, sizes = TABLES.encoded(pieces)
    finally:
        op.LONG = long
    want = [PLAIN._encode_single_piece(p) for p in pieces]
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_very_long_pieces():
    import random

    r = random.Random(3)
    pieces = ["".join(r.choice("etaoinshr") for _ in range(6000)).encode(), b"ab" * 20000, b" " * 50000, b"aaab" * 5000]
    flat, sizes = TABLES.encoded(pieces)
    want = [PLAIN._encode_single_piece(p) for p in pieces]
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, TEXTS[2]])], "doc_id long, text string, ids string")
    rows = op.round_trip(df, PATH, public_tokenizers.PATTERN).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in rows:
        text = [*TEXTS, TEXTS[2]][r.doc_id] or ""
        ids = PLAIN.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))
    assert len(rows) == len(TEXTS) + 1
    apart = op.decode(op.encode(df, PATH, public_tokenizers.PATTERN, keep=("doc_id", "ids")).withColumnRenamed("doc_id", "d").toDF("d", "own", "ids"), PATH)
    assert {r.d: bytes(r.decoded) for r in apart.collect()} == {r.doc_id: (r.text or "").encode() for r in df.collect()}
    nulls = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in op.round_trip(nulls, PATH, public_tokenizers.PATTERN).collect()) == [0, 2]
    assert op.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_gives_texts_back(spark):
    got = {r.doc_id: r for r in op.query(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = PLAIN.encode_ordinary(r.text)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
