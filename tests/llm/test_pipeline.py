import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from remedex.llm import op5_quality_rules, op9_byte_bpe

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of every stage, each written and read again."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, f in corpus_pipeline.STAGES:
        at = f"{tmp_path_factory.mktemp('stage')}/{name}"
        made = f(spark, docs, D)
        assert name == "byte_bpe" or made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        made.write.parquet(at)
        docs = spark.read.parquet(at)
        out.append((name, docs.collect()))
    return dict(out)


def test_rules_and_dedup_take_effect(spark, stages):
    kept = {r.doc_id for r in op5_quality_rules.query(spark, D).where("kept").collect()}
    assert {r.doc_id for r in stages["quality_rules"]} == kept
    texts = [r.text for r in stages["near_dedup"]]
    assert len(set(texts)) == len(texts) <= len(kept)
    assert {r.text for r in stages["near_dedup"]} <= {r.text for r in stages["quality_rules"]}
    seen: set = set()
    for r in sorted(stages["suffix_dedup"], key=lambda r: r.doc_id):
        before = next(x.text for x in stages["near_dedup"] if x.doc_id == r.doc_id)
        assert len(r.text) <= len(before)
        seen.add(r.doc_id)
    assert len(seen) == len(texts)


def test_mix_and_digests(stages):
    before = Counter()
    for r in stages["suffix_dedup"]:
        before[r.doc_id] += len(r.text.split())
    after = Counter()
    for r in stages["source_mixing"]:
        after[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(after[d] <= 3 * before[d] for d in after)
    assert abs(sum(after.values()) / sum(before.values()) - 1) < 0.05
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op9_byte_bpe.load_ranks(public_tokenizers.path(op9_byte_bpe.RANKS)), special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((r.doc_id, len(i := plain.encode_ordinary(r.text)), sha(",".join(map(str, i))), sha(r.text)) for r in stages["source_mixing"])
    assert Counter(tuple(r) for r in stages["byte_bpe"]) == want


def test_run_gives_the_last_stage(spark, stages):
    assert Counter(corpus_pipeline.run(spark, D).collect()) == Counter(stages["byte_bpe"])


def test_null_ids_and_clashing_columns_pass_all_stages(spark, tmp_path):
    """Clean documents stay through the filters, whatever their ids and further columns; an empty table gives no rows."""
    good = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    kept = {r.doc_id for r in op5_quality_rules.query(spark, "/root/testdata/sf0.01").where("kept").collect()}
    texts = [r for r in good if r.doc_id in kept][:12]
    big = 9007199254740993
    ids = [big, big + 2, None, None, 5, 5, *range(100, 106)]
    rows = [(i, r.text, r.lang, r.source, r.n_chars, k, "x", None) for k, (i, r) in enumerate(zip(ids, texts, strict=True))]
    rows.append((7, None, "en", None, 0, 12, "x", None))
    schema = "doc_id long, text string, lang string, source string, n_chars long, tie int, same string, parts int"
    for n, given in enumerate((rows, [])):
        docs = spark.createDataFrame(given, schema)
        for name, f in corpus_pipeline.STAGES:
            made = f(spark, docs, "")
            assert name == "byte_bpe" or made.columns == docs.columns
            made.write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            if name in ("quality_rules", "near_dedup", "suffix_dedup"):
                found = {(r.doc_id, r.tie) for r in docs.collect()}
                whole = {(r[0], r[5]) for r in given if r[1] is not None}
                # Near copies among the chosen documents leave one of each class.
                assert found == whole if name == "quality_rules" else found <= whole and {i for i, _ in found} >= {big, big + 2, None, 5} & {i for i, _ in whole}
        if not given:
            assert docs.count() == 0
