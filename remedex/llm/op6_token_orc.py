"""Token ids as ORC: stripes of run-length encoded integers, row indexes, and Bloom filters on document ids.

Documents are dealt to ranges of doc_id and sorted within them, so the files are in ascending order, row groups have
narrow doc_id bounds, and a lookup reads only the stripes that bounds and Bloom filters leave.  Encoding runs per
partition: the tokenizer drops white space before its merges, so each distinct word is encoded once and the ids of a
text are those of its words in order.  As it also lowers letters and parts them from punctuation, words are lowered and
punctuation at their end is a word of its own, which leaves fewer distinct ones.  Words stay known to a Python worker,
in a bounded table.

Reading back needs no order between tasks: stripes are read in parallel, and the first id of each document is a prefix
sum within its file plus one over the totals of the files.

Defined cases: a null or empty text has the end id alone; documents of equal id follow by length and checksum; other
columns are not written; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.llm.common import _GAP, _LOWER, Lexicon, Scratch, concat, kept, slices, small_batches, table, texts_of

NAME = "op6_token_orc"
END = 2
STRIPE, STRIDE, FPP = 16 << 20, 1000, 0.01
GROUP = 10_000  # words in one call of the tokenizer
KNOWN = 800_000  # words that a Python worker keeps
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True


def loosen(texts: list[bytes]) -> list[list[bytes]]:
    """The words of the texts, lowered, with runs of ASCII marks between an ASCII letter and the word's end apart.

    Texts that may hold a special token are only split.
    """
    if any(b"<|" in t for t in texts):
        return [t.split() for t in texts]
    buf, bounds = concat(texts)
    if not len(buf):
        return [[] for _ in texts]
    low = _LOWER[buf]
    marks = _MARKS[low]
    at = np.flatnonzero((low[:-1] >= 97) & (low[:-1] <= 122) & marks[1:]) + 1
    which = np.searchsorted(bounds, at, side="right")
    stops = np.append(np.flatnonzero(~marks), len(buf))
    end = np.minimum(stops[np.searchsorted(stops, at)], bounds[which])
    at = at[((end == bounds[which]) | _GAP[low[np.minimum(end, len(buf) - 1)]]) & (at > bounds[which - 1])]
    data = np.insert(low, at, 32).tobytes()
    bounds = (bounds + np.searchsorted(at, bounds, side="left")).tolist()
    return [data[a:b].split() for a, b in zip(bounds, bounds[1:], strict=False)]


def word_encoder(path: str):
    """Ids of distinct words by one call for many, with a special token between them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = tokenizer.get_added_tokens_decoder()
    mark = next((t.content for t in special.values()), None)
    cut = tokenizer.token_to_id(mark) if mark else None
    marks = [t.content.encode() for t in special.values()]
    plain = lambda w: w.decode(errors="replace")

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        apart = [i for i, w in enumerate(new) if cut is None or any(m in w for m in marks)]
        alone = set(apart)
        together = [i for i in range(len(new)) if i not in alone]
        out: list = [None] * len(new)
        for i in apart:
            out[i] = np.array(tokenizer.encode(plain(new[i]), add_special_tokens=False).ids, dtype=np.int32)
        for a in range(0, len(together), GROUP):
            part = together[a : a + GROUP]
            ids = np.array(tokenizer.encode_batch_fast([mark.join(plain(new[i]) for i in part)], add_special_tokens=False)[0].ids, dtype=np.int32)
            for i, x in zip(part, np.split(ids, np.flatnonzero(ids == cut)), strict=True):
                out[i] = x[1:] if len(x) and x[0] == cut else x
        return np.concatenate([np.zeros(0, np.int32), *out]), np.array([len(x) for x in out], dtype=np.int64)

    return encode


def encode(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id and ids (array of int) of every row; ``end`` follows the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("words", path), lambda: Lexicon(word_encoder(path), KNOWN))
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in slices([len(t) for t in texts], 4 << 20):
                split = loosen(texts[lo:hi])
                known.add({w for x in split for w in x})
                sizes = np.array([len(x) for x in split])
                number = known.number
                ids, n = known.ids(np.fromiter((number[w] for x in split for w in x), dtype=np.int64, count=int(sizes.sum())))
                at = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
                ids = np.insert(ids, at[1:], end)
                at += np.arange(len(at))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of all documents in ascending order of doc_id."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        encode(ordered, tokenizer)
        .write.option("orc.stripe.size", STRIPE)
        .option("orc.row.index.stride", STRIDE)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", FPP)
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, and the file of each row; filters on doc_id prune stripes by bounds and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path).withColumn("file", F.input_file_name())


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, file, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")))
            at = ids.offsets.to_numpy().tolist()
            crc = [zlib.crc32(raw[a:e]) for a, e in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, file string, n_tokens long, ids_crc32 long")


def starts(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: prefix sums within the files and over the files in order."""
    files = found.groupBy("file").agg(F.min("doc_id").alias("lo"), F.sum("n_tokens").alias("n"))
    before = W.orderBy("lo", "file").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = W.partitionBy("file").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    out = found.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(files, "file")
    return out.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    write(table(spark, sf_dir, "documents"), f"{scratch.path}/ids", public_tokenizers.path("word_bpe_49k.json"))
    found = scratch.put(digests(read(spark, f"{scratch.path}/ids")), "found")
    scratch.drop("ids")
    return starts(found)
