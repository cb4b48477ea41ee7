"""From raw documents to token digests in five stages; each reads what the stage before it wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Defined cases: a null text has no words and goes with the quality rules; documents of null, equal or very large ids are kept like
others, equal ones in id and text once; further columns stay, whatever their names, up to the last stage; ties go by the rules of
each operator; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from remedex.llm import op2_suffix_dedup, op4_source_mixing, op5_quality_rules, op9_byte_bpe, op10_order_minhash
from remedex.llm.common import Scratch, table

_scratch: list[Scratch] = []


def _fresh(spark: SparkSession) -> Scratch:
    """Scratch tables for a stage. Those of the stages before it go, as their results have been written."""
    while _scratch:
        _scratch.pop().drop()
    _scratch.append(Scratch(spark))
    return _scratch[-1]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return op5_quality_rules.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return op10_order_minhash.keep_one(docs, _fresh(spark))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that also start earlier."""
    return op2_suffix_dedup.cut_documents(docs, _fresh(spark))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights: a row for each pass over a document, with the words taken in it."""
    return op4_source_mixing.mixed_documents(docs, _fresh(spark))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the ids, and digest of the decoded bytes of every row."""
    return op9_byte_bpe.round_trip(docs, public_tokenizers.path(op9_byte_bpe.RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]
#: SQL cannot express alignment, multinomial draws or byte merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the result of every other stage is written and read again."""
    kept, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept.put(docs, name)
            if k:
                kept.drop(STAGES[k - 1][0])
    return docs
