"""Near-duplicates by Order MinHash, verified by banded alignment.

The k-mers of a text are its runs of five words, each labelled with its occurrence number.  For every hash function
the two k-mers of least hash are kept in their text order; two texts agree in such an entry only if they share both
k-mers in the same order, so agreement falls with edits and with moved parts.

1. Rows of equal text are one text with a number of its own; all further steps work on texts.
2. The first entries are keys.  Texts that share a key compare whole sketches in blocks; those that agree in enough
   entries are joined to candidate groups.  Groups that share a passage only do not agree in enough entries.
3. The texts of a candidate group meet in blocks.  The size of the common k-mers of all pairs of a block comes from a
   matrix product; pairs whose k-mers resemble each other by ``RESEMBLE`` and are not yet joined are aligned word by word: with
   m words in the longest common subsequence of n1 and n2 words, m / (n1 + n2 - m) must reach 0.8.  Words further apart than
   the band that the threshold allows cannot be in it, and pairs without enough words in common, in any order, are not aligned.  The chain of common k-mers gives most of it at once; only where that
   is not enough, the words between are aligned exactly, by bit vectors.

A group is split into blocks by bytes and by rows and every pair of blocks is a task's group of its own, so no task
holds more than two blocks and nothing is capped; only a spanning forest of the links leaves a block.

An entry of two texts agrees with the square of their k-mers' resemblance.  At a resemblance of 0.5 a pair misses all ``KEYS``
keys in about 1 of 100 cases and falls below ``AGREE`` of ``ENTRIES`` entries in about 19; with one word in twenty replaced
(0.63) the first is below 1 in 1,000 and the second about 1 in 1,000.

Defined cases: a null text counts as empty; texts of fewer than five words have one k-mer of all their words; texts
without words are joined by equality only; rows of equal doc_id and text are one document, rows of one doc_id with different
texts are documents of their own; a null doc_id is a document like others, comes last where the least id stands for a
class, and is the class_id only of classes without another; other columns are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.llm.common import STEP, ByteHash, Scratch, concat, gather, groups, mix, powers, small_batches, table, texts_of, word_bounds
from remedex.llm.components import components

NAME = "op10_order_minhash"
K, ENTRIES, KEYS, AGREE, SIMILARITY = 5, 64, 16, 13, 0.8
RESEMBLE = 0.5  # of the k-mers, for texts that may reach the similarity
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
_ODD = np.random.default_rng(10).integers(1 << 31, 1 << 32, ENTRIES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = np.random.default_rng(11).integers(0, 1 << 32, ENTRIES, dtype=np.uint64).astype(np.uint32)


def kmers(texts: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of the texts one after the other, the bounds of each text, and both for words."""
    buf, bounds = concat(texts)
    starts, ends, n = word_bounds(buf, bounds)
    at = np.concatenate([[0], np.cumsum(n)])
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(size)])
    if not len(starts):
        return np.zeros(0, np.uint64), out_at, np.zeros(0, np.uint64), at
    words = ByteHash(buf).of(starts, ends)
    with np.errstate(over="ignore"):
        # A run's hash is a polynomial of its word hashes; short texts use the words that they have.
        first = np.arange(out_at[-1]) - np.repeat(out_at[:-1], size) + np.repeat(at[:-1], size)
        h = np.zeros(len(first), dtype=np.uint64)
        last = np.repeat(at[1:], size)
        for p in powers(STEP, k)[::-1]:
            h += np.where(first < last, words[np.minimum(first, len(words) - 1)], np.uint64(0)) * p
            first = first + 1
        h = mix(h)
        # Occurrence labels: equal k-mers of a text are numbered in text order.
        doc = np.repeat(np.arange(len(size), dtype=np.uint64), size)
        key = h ^ mix(doc + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        if same.any():
            run = np.arange(len(same)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            label = np.zeros(len(h), dtype=np.uint64)
            label[order] = run.astype(np.uint64)
            h = np.where(label > 0, mix(h + label * STEP), h)
    return h, out_at, words, at


def sketch(h: np.ndarray) -> np.ndarray:
    """The entries of a text: for each hash function its two least k-mers in text order."""
    if not len(h):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        v = (h >> np.uint64(32)).astype(np.uint32) * _ODD[:, None] + _ADD[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        a = v.argmin(axis=1)
        if len(h) == 1:
            return mix(np.repeat(h, ENTRIES))
        v[np.arange(ENTRIES), a] = np.uint32(0xFFFFFFFF)
        b = v.argmin(axis=1)
        return mix(h[np.minimum(a, b)] * STEP + h[np.maximum(a, b)])


def chain(a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the longest common chain of labelled k-mers whose places differ by at most ``band``."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    order = np.argsort(i)
    i, j = i[order], j[order]
    tails: list[int] = []
    last: list[int] = []  # number of the k-mer that ends the best chain of each length
    back = np.full(len(j), -1)
    for k, x in enumerate(j.tolist()):
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
            last.append(k)
        else:
            tails[at], last[at] = x, k
        back[k] = last[at - 1] if at else -1
    k, got = last[-1] if last else -1, []
    while k >= 0:
        got.append(k)
        k = back[k]
    return i[got[::-1]], j[got[::-1]]


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    where: dict[int, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    whole = state = (1 << len(a)) - 1
    for w in b:
        if hit := state & where.get(w, 0):
            state = (state + hit | state - hit) & whole
    return head + tail + len(a) - state.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, words_a: np.ndarray, words_b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether m / (n1 + n2 - m) reaches the similarity, for texts with k-mers a and b. No word outside the band can be matched."""
    n1, n2 = len(words_a), len(words_b)
    need = int(np.ceil(similarity / (1 + similarity) * (n1 + n2) - 1e-9))
    band = max(n1, n2) - need
    if need > min(n1, n2) or not need:
        return False
    i, j = chain(a, b, band)
    # Each k-mer of the chain matches its words up to the next one's.
    m = int(np.minimum(np.minimum(np.diff(i), np.diff(j)), K).sum()) + min(K, n1, n2) if len(i) else 0
    return m >= need or common_words(words_a, words_b) >= need


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def blocks(rows: DataFrame, sizes: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows with block, lo and hi: each row once for each pair of blocks of its group. ``sizes`` has keys and ``blocks``."""
    out = rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumns({"lo": F.least("block", "_o"), "hi": F.greatest("block", "_o")}).drop("_o", "blocks")


def _edges(forest: Forest, ids: np.ndarray) -> list[tuple[int, int]]:
    return [(int(ids[i]), int(ids[forest.root(i)])) for i in range(len(ids)) if forest.root(i) != i]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, same (hash of the text), size, keys (array) and entries (binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(KEYS, dtype=np.uint64)
        for b in batches:
            texts = texts_of(b.column(2))
            h, at, _, _ = kmers(texts)
            made = [sketch(h[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            keys = [mix(s[:KEYS] + number).astype(np.int64) if len(s) else np.zeros(0, np.int64) for s in made]
            size = pa.array([len(t) for t in texts], pa.int64())
            entries = pa.array([s.astype(np.uint32).tobytes() for s in made], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, pa.array(keys, pa.list_(pa.int64())), entries], ["doc_id", "same", "size", "keys", "entries"])

    small_batches(docs.sparkSession)
    return _rows(docs).mapInArrow(run, "doc_id long, same string, size long, keys array<long>, entries binary")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.sha2(text, 256).alias("same"), text.alias("text"))


def candidate_edges(made: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: a spanning forest of the texts that share a key and agree in enough entries."""
    keyed = made.select("doc_id", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / 1024).cast("int").alias("blocks"))
    rows = keyed.join(scratch.put(sizes, "keys"), "key")
    # Sketches follow only the keys that are shared.
    rows = blocks(rows.select("doc_id", "key"), scratch.spark.read.parquet(f"{scratch.path}/keys"), ["key"], "doc_id")
    rows = rows.join(made.select("doc_id", "entries"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for g in groups(batches, ["key", "lo", "hi"]):
            ids, block = g["doc_id"].to_numpy(), g["block"].to_numpy()
            e = np.frombuffer(b"".join(g["entries"]), dtype=np.uint32).reshape(len(g), ENTRIES)
            forest, lo, hi = Forest(len(g)), int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
            right = np.flatnonzero(block == hi)
            left = set(np.flatnonzero(block == lo).tolist())
            open_ = right  # those not yet in one tree with all rows seen
            for i in sorted(left):
                todo = open_[open_ > i] if lo == hi else open_
                near = todo[(e[todo] == e[i]).sum(1) >= AGREE]
                for j in near.tolist():
                    forest.join(i, j)
            out += _edges(forest, ids)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return gather(rows.select("key", "lo", "hi", "block", "doc_id", "entries"), ["key", "lo", "hi"]).mapInPandas(run, "a long, b long")


def common_sizes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of common labelled k-mers of all pairs of texts, by products of 0/1 matrices over slices of the k-mers."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    kinds, column, count = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(kinds), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    keep = column >= 0
    column, doc = column[keep], doc[keep]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    out = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((n, min(4096, len(shared) - lo)), dtype=np.float32)
        x[doc[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def _enough_words(near: np.ndarray, texts: list[bytes], n: np.ndarray) -> np.ndarray:
    """Which pairs have as many words in common, whatever their order, as the similarity needs. Texts that share a long
    passage only do not, so they are not aligned."""
    some = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
    out = np.zeros_like(near)
    if len(some):
        h, at, _, _ = kmers([texts[i] for i in some], 1)
        out[np.ix_(some, some)] = common_sizes(h, at) >= SIMILARITY / (1 + SIMILARITY) * (n[some][:, None] + n[some]) - 1e-3
    return out


def links(rows: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the pairs that reach the similarity, from rows (cluster, lo, hi, block, doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for g in groups(batches, ["cluster", "lo", "hi"]):
            ids, block = g["doc_id"].to_numpy(), g["block"].to_numpy()
            texts = [t.encode(errors="surrogatepass") for t in g["text"]]
            h, at, words, word_at = kmers(texts)
            size = np.diff(at).astype(np.float32)
            both = common_sizes(h, at)
            near = (both > 0) & (both >= RESEMBLE * (size[:, None] + size - both) - 1e-3)
            lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
            near &= (block == lo)[:, None] & (block == hi)
            near &= _enough_words(near, texts, np.diff(word_at))
            if lo == hi:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            best = np.argsort(-both[i, j], kind="stable")
            forest = Forest(len(g))
            for x, y in zip(i[best].tolist(), j[best].tolist(), strict=True):
                if forest.root(x) != forest.root(y) and aligned(*(v[t[k] : t[k + 1]] for v, t in ((h, at), (words, word_at)) for k in (x, y))):
                    forest.join(x, y)
            out += _edges(forest, ids)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return gather(rows, ["cluster", "lo", "hi"]).mapInPandas(run, "a long, b long")


def _classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, same, class_id, and ``kept``: whether the document stands for its class; one row for each document."""
    made = scratch.put(sketches(docs), "sketches")
    texts = made.groupBy("same").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("entries").alias("entries"))
    texts = scratch.put(texts.withColumn("doc_id", F.monotonically_increasing_id()), "texts")
    clusters = components(scratch.put(candidate_edges(texts, scratch), "candidates"), scratch, "clusters").withColumnsRenamed({"node": "doc_id", "component": "cluster"})
    sized = texts.select("doc_id", "size").join(clusters, "doc_id")
    counts = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    # One row of each text; the document of least id is one of few that hold it.
    whole = texts.join(clusters, "doc_id", "left_semi").select("same", "least", "doc_id")
    whole = _texts(_rows(docs).withColumnRenamed("doc_id", "least"), whole)
    placed = blocks(clusters, counts, ["cluster"], "doc_id")
    found = scratch.put(links(whole.join(placed, "doc_id").select("cluster", "lo", "hi", "block", "doc_id", "text")), "links")
    named = components(found, scratch, "classes").select(F.col("node").alias("doc_id"), F.col("component").alias("class"))
    facts = texts.select("doc_id", "same", "least").join(named, "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
    first = facts.groupBy("class").agg(F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull(), "least", "same")).alias("head"))
    facts = facts.join(first, "class").select("same", "least", "class_id", (F.col("head.same") == F.col("same")).alias("first"))
    own = made.select("doc_id", "same").distinct().join(facts, "same")
    return own.select("doc_id", "same", "class_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("least"))).alias("kept"))


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id (the text's number) and text, from the documents that hold the wanted texts under their least id."""
    w = wanted.select(F.col("same").alias("_same"), F.col("least").alias("_least"), "doc_id")
    met = rows.join(w, (F.col("same") == F.col("_same")) & F.col("least").eqNullSafe(F.col("_least")))
    return met.groupBy("doc_id").agg(F.first("text").alias("text"))


def classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept, for every document."""
    return _classes(docs, scratch).drop("same")


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One document of each class, that of least doc_id, with its own columns."""
    first = scratch.put(_classes(docs, scratch).where("kept").select("doc_id", "same"), "first")
    # The document's columns are held in one, so their names do not matter.
    rows = docs.select(F.col("doc_id").alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_same"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    one = rows.join(first, (F.col("_id").eqNullSafe(F.col("doc_id"))) & (F.col("_same") == F.col("same")), "left_semi")
    return one.dropDuplicates(["_id", "_same"]).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), Scratch(spark))
