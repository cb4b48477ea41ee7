"""Ranked lexical search over postings that are bucketed by term.

Index.  A row holds the postings of a term in one chunk of documents: places in the chunk, occurrences, and sizes of the
documents in terms.  Rows are bucketed and sorted by (term, part); the part comes from the chunk and parts hold about ``PART``
documents, so a word of every document is dealt over many buckets.  The rows of the empty term stand for the documents
themselves: their ids and sizes.  A join on (term, part) reads the buckets as they lie and moves the terms of the items only.

Search.  Item terms join the postings; a match scores w * ((10^9 tf) div (1000 tf + 12 m)); matches are summed by item
and document; a window ranks them.  A word of half of all documents would make a row for each of them and each item, so:

1. The rarest terms of each item, up to ``OPEN`` postings, are summed. The best ``TRIED`` documents by these sums get their whole scores; the
   k-th highest of them is a floor of the k-th highest score of all.
2. A term adds at most q * w * (its highest quotient in any document).  The terms of least bound whose bounds add up to
   less than the floor cannot bring a document to the head without another term of the item.  All other terms are summed.
3. Documents whose sum and those bounds reach the floor get what the terms left out add.

What is added later is looked up by (term, chunk): the asked places of a chunk meet the term's row there once.
Steps 2 and 3 leave out only what cannot rank, so the result is that of the full sums at every size.

Defined cases: null text has no terms; every row is a document, repeated rows rank apart; an item without terms, or whose
terms are nowhere, has no rows; rows of equal item_id and text are one item; equal scores rank by doc_id, null first; an empty
table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.llm.common import Numbers, Scratch, counted, parallelism, separators, small_batches, table, texts_of

NAME = "op12_lexical_search"
TOP = 20
CHUNK = 24 << 20  # bytes of text in a chunk
PART = 50_000  # documents in a part, about
OPEN, TRIED = 20_000, 100  # postings of an item that are summed first, and documents scored whole for its floor
SHARE = 0.5  # of the floor, that the terms left out may add up to; 1 would be right too, but leaves more documents near
ROWS = 10_000  # rows of an Arrow batch
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = separators(digits=True)
_SCHEMA = "term string, part int, chunk long, places array<int>, tfs array<int>, sizes array<int>, ids array<long>"


class _Chunk:
    """Postings of some documents."""

    def __init__(self, number: int):
        self.number, self.bytes, self.terms, self.keys, self.tfs, self.sizes, self.ids = number, 0, Numbers(), [], [], [], []

    def add(self, ids: list, texts: list[bytes]) -> None:
        number, n = self.terms.of([t.translate(_TABLE).split() for t in texts])
        place = np.arange(len(n), dtype=np.int64) + len(self.ids)
        keys, tf = counted(number << 32 | np.repeat(place, n))
        self.keys.append(keys)
        self.tfs.append(tf.astype(np.int32))
        self.sizes.append(n.astype(np.int32))
        self.ids += ids
        self.bytes += sum(map(len, texts))

    def rows(self, parts: int) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        keys, tf, sizes = np.concatenate(self.keys), np.concatenate(self.tfs), np.concatenate(self.sizes)
        part = self.number * 0x9E3779B1 % (1 << 32) % parts
        held = np.flatnonzero(sizes).astype(np.int32)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        ids = [self.ids[i] for i in held.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([""]), pa.array([part], pa.int32()), pa.array([self.number]), one(held, pa.int32()), one(sizes[held], pa.int32()), one(sizes[held], pa.int32()), one(ids, pa.int64())],
            schema=_ARROW,
        )
        order = np.argsort(keys, kind="stable")
        keys, tf = keys[order], tf[order]
        term, place = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
        at = np.append(np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])), len(term)) if len(term) else np.zeros(1, np.int64)
        words = pa.array(list(self.terms.number), pa.binary()).cast(pa.string())
        for lo in range(0, len(at) - 1, ROWS):
            some = at[lo : lo + ROWS + 1]
            n, span = len(some) - 1, slice(some[0], some[-1])
            offsets = pa.array((some - some[0]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place[span], tf[span], sizes[place[span]])]
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(term[some[:-1]])), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, self.number, np.int64)), *lists, pa.nulls(n, pa.list_(pa.int64()))], schema=_ARROW
            )


_LIST = pa.list_(pa.int32())
_ARROW = pa.schema([("term", pa.string()), ("part", pa.int32()), ("chunk", pa.int64()), ("places", _LIST), ("tfs", _LIST), ("sizes", _LIST), ("ids", pa.list_(pa.int64()))])


def postings(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of the index, as its tasks make them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 20  # chunks of a task have numbers of their own
        held = _Chunk(first)
        for b in batches:
            held.add(b.column(0).to_pylist(), texts_of(b.column(1)))
            if held.bytes > CHUNK:
                yield from held.rows(parts)
                held = _Chunk(held.number + 1)
        yield from held.rows(parts)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def index(docs: DataFrame, scratch: Scratch) -> tuple[str, int]:
    """Name of a bucketed table of the postings of all documents, and the number of its parts."""
    spark, name = docs.sparkSession, f"postings_{uuid.uuid4().hex}"
    parts, buckets = docs.count() // PART + 1, parallelism(docs.sparkSession)
    rows = postings(docs, parts).repartition(buckets, "term", "part")
    rows.write.bucketBy(buckets, "term", "part").sortBy("term", "part").option("path", f"{scratch.path}/{name}").option("compression", "zstd").saveAsTable(name)
    return name, parts


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id and terms; the number of an item is made when the rows are written."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    return rows.select(F.monotonically_increasing_id().alias("item"), "item_id", F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("terms"))


def _sums(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """item, chunk, place and the summed score of the asked terms (item, term, weight)."""
    rows = hits.join(asked.select("item", "term", "weight"), "term")
    rows = rows.select("item", "chunk", "weight", F.inline(F.arrays_zip("places", "scores")).alias("place", "part_score"))
    return rows.groupBy("item", "chunk", "place").agg(F.sum(F.col("weight") * F.col("part_score")).alias("score"))


def _completed(found: DataFrame, terms: DataFrame, hits: DataFrame) -> DataFrame:
    """item, chunk, place, score: found documents with what further terms (item, term, weight) add to their scores."""
    asked = found.join(terms.select("item", "term", "weight"), "item").groupBy("term", "chunk").agg(F.collect_list(F.struct("item", "place", "weight")).alias("asked"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, places, scores, wanted in zip(*b.columns, strict=True):
                at, wanted = places.values.to_numpy(), wanted.values
                item, place, weight = (wanted.field(k).to_numpy() for k in ("item", "place", "weight"))
                k = np.minimum(np.searchsorted(at, place), len(at) - 1)
                hit = at[k] == place
                if hit.any():
                    score = weight[hit] * scores.values.to_numpy()[k[hit]].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(item[hit]), pa.array(np.full(len(score), chunk.as_py(), np.int64)), pa.array(place[hit]), pa.array(score)], ["item", "chunk", "place", "score"])

    met = hits.join(asked, ["term", "chunk"]).select("chunk", "places", "scores", "asked")  # one row of each side
    more = met.mapInArrow(add, "item long, chunk long, place int, score long")
    return found.select("item", "chunk", "place", "score").unionByName(more).groupBy("item", "chunk", "place").agg(F.sum("score").alias("score"))


def _head(sums: DataFrame, n: int) -> DataFrame:
    """The n highest sums of each item, with their place ``r``."""
    return sums.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") <= n)


def search(spark: SparkSession, index_name: str, parts: int, items: DataFrame, scratch: Scratch, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score."""
    postings_ = spark.table(index_name)
    own = postings_.where("term = ''")
    whole = own.select(F.sum(F.size("tfs")).alias("n"), F.sum(F.expr("aggregate(tfs, 0L, (a, x) -> a + x)")).alias("l")).first()
    n, length = int(whole["n"] or 0), int(whole["l"] or 0)
    if not n:
        return spark.createDataFrame([], _result(items))
    named = scratch.put(item_terms(items), "items")
    asked = named.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count("*").alias("q"))
    # The rows of the terms that are asked for, with the score of each posting before its term's weight.
    slots = asked.select("term").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    score = f"transform(arrays_zip(tfs, sizes), x -> int((1000000000L * x.tfs) div (1000L * x.tfs + 12L * (75L + (25L * x.sizes * {n}L) div {length}L))))"
    hits = scratch.put(postings_.join(slots, ["term", "part"]).select("term", "chunk", "places", F.expr(score).alias("scores")), "hits")
    facts = hits.groupBy("term").agg(F.sum(F.size("places")).alias("df"), F.max(F.array_max("scores")).alias("peak"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long") * F.col("q")
    asked = asked.join(facts, "term").withColumn("weight", weight).where("weight > 0").withColumn("bound", F.col("weight") * F.col("peak"))
    by_df, by_bound = (W.partitionBy("item").orderBy(c, "term").rowsBetween(W.unboundedPreceding, 0) for c in ("df", "bound"))
    opened = (F.sum("df").over(by_df) <= OPEN) | (F.count("*").over(by_df) == 1)
    asked = scratch.put(asked.select("item", "term", "weight", opened.alias("opened"), F.sum("bound").over(by_bound).alias("below")), "asked")
    tried = scratch.put(_head(_sums(hits, asked.where("opened")), max(TRIED, top)), "tried")
    floor = _head(_completed(tried, asked.where("NOT opened"), hits), top).where(F.col("r") == top).select("item", F.col("score").alias("floor"))
    split = asked.join(floor, "item", "left").na.fill(0, ["floor"])
    split = scratch.put(split.select("item", "term", "weight", "below", "floor", (F.col("below") < SHARE * F.col("floor")).alias("rest")), "split")
    bar = split.groupBy("item").agg((F.max("floor") - F.coalesce(F.max(F.when(F.col("rest"), F.col("below"))), F.lit(0))).alias("least"))
    near = scratch.put(_sums(hits, split.where("NOT rest")).join(bar, "item").where("score >= least").drop("least"), "near")
    total = _completed(near, split.where("rest"), hits).where("score > 0")
    # Ties at the end are settled by doc_id, which only documents that reach the head need.
    head = total.withColumn("r", F.rank().over(W.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") <= top)
    ids = own.select("chunk", F.inline(F.arrays_zip("places", "ids")).alias("place", "doc_id"))
    by = W.partitionBy("item").orderBy(F.desc("score"), "doc_id", "chunk", "place")
    ranked = head.join(ids, ["chunk", "place"]).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _result(items: DataFrame) -> str:
    return f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    name, parts = index(table(spark, sf_dir, "documents"), scratch)
    return search(spark, name, parts, table(spark, sf_dir, "benchmark"), scratch)


ORACLE = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(whole.n) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * size.n * whole.n) // whole.l))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), whole GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
