"""Vector best-fit packing of documents into sequences.

1. Documents are encoded where they are read.  One longer than a sequence is cut into full pieces behind a first piece that
   takes the rest, so full pieces fill sequences of their own and every document has at most one piece to be packed.
2. A piece takes tokens, a place of the allowed documents, and attention cost (its length squared), all of which follow
   from its length.  So the pieces are packed by their counts for each length, of which there are as many as tokens in a
   sequence, whatever the corpus: from the longest to the shortest, each goes to the bin that fits best under every
   capacity.  Bins with equal residual capacities are one entry with a range of numbers, and a step fills as many of
   them as there are pieces.  Best is the least weighted norm of what is left (``norm``), or the largest weighted dot product
   of the piece and the residual (``dot``).
3. Pieces of a length are numbered over all tasks by two prefix sums, and a piece's number says in which range of bins,
   and at which offset, it lies.

The plan has a row for each range that a length fills; their number depends on the capacities and not on the corpus, so it
may go to all tasks.  Nothing else passes the driver.

Encoding asks the tokenizer once for each distinct chunk of text that a Python worker knows: a text is cut only where the
tokenizer's own pattern always cuts, and texts that may hold a special token are not cut.

Defined cases: a null or empty text is one piece of the end id; repeated rows are packed one by one; ids may be null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.llm.common import Lexicon, Scratch, concat, kept, slices, small_batches, table, texts_of

NAME = "op13_best_fit_packing"
TOKENIZER, END = "byte_bpe_50k.json", 2
TOKENS = 1024
WEIGHTS = (1.0, 0.25, 0.25)  # of tokens, documents and attention cost in the score of a bin
KNOWN = 1_000_000  # chunks of text that a Python worker keeps
ROWS_PER_BUCKET = 20_000

_GRAPH = np.zeros(256, dtype=bool)
_GRAPH[33:127] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = _GRAPH & ~_LETTER
_MARK[48:58] = _MARK[39] = False
#: First bytes of two-byte characters of which none is white space.
_TWO = np.zeros(256, dtype=bool)
_TWO[0xC3:0xE0] = True


#: White space other than blanks and line ends, as the pattern knows it, and what may begin a special token.
_OTHER = [bytes([b]) for b in (9, 11, 12, 13, 28, 29, 30, 31)] + [bytes(b) for b in ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A, 0x80), (0xE1, 0xA0, 0x8E), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80))]
_OTHER += [bytes((0xE2, 0x80, b)) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [b"<|"]


def plain(text: bytes) -> bool:
    """Whether all white space is in runs of one or two blanks or line ends, and none of two ends the text.

    The pattern takes all but the last of a run as one token, and a run at the end whole, so in such a text it cuts around every
    line end and before every blank.
    """
    blank = text.replace(b"\n", b" ")
    return b"   " not in blank and not blank.endswith(b"  ") and not any(x in text for x in _OTHER)


#: Letters and digits as ``a``, full stops and commas as ``,``, all else as a blank.
_CLASS = bytes(97 if chr(b).isalnum() and b < 128 else 44 if b in b".," else 32 for b in range(256))


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """The texts in chunks whose ids are those of the text when put together; chunks may be empty."""
    return [_plain_chunks(t) if plain(t) else [t] if b"<|" in t else careful_chunks([t])[0] for t in texts]


def _plain_chunks(text: bytes) -> list[bytes]:
    kinds = text.translate(_CLASS)
    if kinds.count(b",") == kinds.count(b"a,"):  # the pattern cuts between a word and its mark
        text = text.replace(b",", b"\xff,").replace(b".", b"\xff.")
    return text.replace(b"\n", b"\xff\n\xff").replace(b" ", b"\xff ").split(b"\xff")


def careful_chunks(texts: list[bytes]) -> list[list[bytes]]:
    """The same for any white space, but not for special tokens."""
    buf, bounds = concat(texts)
    if len(buf) < 3:
        return [[t] if t else [] for t in texts]
    before, at, after = buf[:-2], buf[1:-1], buf[2:]
    # Characters that end just before a byte, and that begin at it, and are not white space.
    ends = _GRAPH[before].copy()
    ends[1:] |= _TWO[before[:-1]] & (before[1:] >= 128)
    begins = _GRAPH[after] | _TWO[after]
    cut = (at == 32) & ends & begins  # before a single space
    cut |= (at == 10) & ends  # before a line end
    cut |= _LETTER[before] & _MARK[at]  # before a mark
    places = np.flatnonzero(cut) + 1
    places = np.concatenate([places, np.flatnonzero((at == 10) & ends & _GRAPH[after]) + 2])  # after a single line end
    # A cut looks at both sides, which must be of one text: those within two bytes of a bound are left out.
    places = np.unique(places)
    near = np.searchsorted(bounds, places, side="right")
    places = places[(places - bounds[near - 1] >= 2) & (bounds[np.minimum(near, len(bounds) - 1)] - places >= 2)]
    data = np.insert(buf, places, 255).tobytes()  # no byte of UTF-8
    bounds = (bounds + np.searchsorted(places, bounds, side="left")).tolist()
    return [data[a:b].split(b"\xff") if b > a else [] for a, b in zip(bounds, bounds[1:], strict=False)]


def chunk_encoder(path: str):
    """Ids of distinct chunks by the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in tokenizer.encode_batch_fast([w.decode(errors="replace") for w in new], add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        return np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(sizes.sum())), sizes

    return encode


class _Numbers(dict):
    """Numbers of chunks; one that is looked up for the first time gets the next, and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class Chunks(Lexicon):
    """The chunks that a Python worker knows. Each chunk of a text is looked up once, new ones are encoded after."""

    def clear(self) -> None:
        super().clear()
        self.number = _Numbers()

    def numbers(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of the split texts one after the other, and how many each text has."""
        if len(self.number) > self.most:
            self.clear()
        sizes = np.array([len(x) for x in split], dtype=np.int64)
        out = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
        if self.number.new:
            flat, n = self.encode(self.number.new)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
            self.flat = np.concatenate([self.flat, flat])
            self.number.new.clear()
        return out, sizes


def encoded(docs: DataFrame, path: str, end: int = END, tokens: int = TOKENS, ids: bool = False) -> DataFrame:
    """doc_id, row (a number of its own), first (tokens of a first piece below a full one), full (the number of full pieces)
    and the unsigned crc32 of each piece's ids; with ``ids`` the ids themselves."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row", "first", "full", "crcs", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("chunks", path), lambda: Chunks(chunk_encoder(path), KNOWN))
        for b in batches:
            texts = texts_of(b.column(2))
            for lo, hi in slices([len(t) for t in texts], 4 << 20):
                split = chunks(texts[lo:hi])
                numbers, sizes = known.numbers(split)
                flat, n = known.ids(numbers)
                at = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
                flat = np.insert(flat, at[1:], end).astype("<u4")
                at = at + np.arange(len(at))
                length = np.diff(at)
                raw = memoryview(flat).cast("B")
                crcs = [[zlib.crc32(raw[4 * x : 4 * y]) for x, y in _pieces(a, e, tokens)] for a, e in zip(at.tolist(), at[1:].tolist(), strict=False)]
                made = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array((length % tokens).astype(np.int32)), pa.array(length // tokens), pa.array(crcs, pa.list_(pa.int64()))]
                if ids:
                    made.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(made, names)

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row long, first int, full long, crcs array<long>" + (", ids array<int>" if ids else ""))


def _pieces(start: int, end: int, tokens: int) -> Iterator[tuple[int, int]]:
    """Bounds of the pieces of ids [start, end): the first may be shorter."""
    first = start + (end - start) % tokens
    if first > start:
        yield start, first
    for x in range(first, end, tokens):
        yield x, x + tokens


class Plan:
    """Where the pieces of each length go: rows (length, from, bin, each, offset), and the number of bins.

    Pieces from number ``from`` on lie in bins ``bin`` and after, ``each`` in one, the first at ``offset``.
    """

    def __init__(self, counts: dict[int, int], tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, rule: str = "norm", weights=WEIGHTS):
        documents, cost = tokens if documents is None else documents, tokens * tokens if cost is None else cost
        if rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {rule}")
        if documents < 1 or cost < tokens * tokens:
            raise ValueError("a full piece must fit an empty sequence")
        self.capacity = np.array([tokens, documents, cost], dtype=np.int64)
        self.weights = np.array(weights) / self.capacity.astype(float) ** 2
        self.left, self.range = np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.bins, self.rule = 0, rule
        for length in sorted(counts, reverse=True):
            self._place(length, counts[length])

    def _place(self, length: int, n: int) -> None:
        piece, done = np.array([length, 1, length * length], dtype=np.int64), 0
        while done < n:
            fits = np.flatnonzero((self.left >= piece).all(axis=1))
            if len(fits):
                left = self.left[fits]
                score = -((left - piece) ** 2 @ self.weights) if self.rule == "norm" else (left * piece) @ self.weights
                best = int(fits[np.argmax(score)])
                left, (lo, hi) = self.left[best], self.range[best]
                self.left, self.range = np.delete(self.left, best, 0), np.delete(self.range, best, 0)
            else:
                # New bins: as many as the pieces that are left fill.
                left = self.capacity
                lo, hi = self.bins, self.bins + -(-(n - done) // int((left // piece).min()))
                self.bins = hi
            # By the norm, a bin that took a piece is the best one for the next of that length.
            each = int((left // piece).min()) if self.rule == "norm" else 1
            whole = min(hi - lo, (n - done) // each)
            for size, take in ((whole, each), (1, n - done - whole * each if whole < hi - lo else 0)):
                if size and take:
                    self.rows.append((length, done, lo, take, int(self.capacity[0] - left[0])))
                    self._hold(left - take * piece, lo, lo + size)
                    lo, done = lo + size, done + size * take
            self._hold(left, lo, hi)

    def _hold(self, left: np.ndarray, lo: int, hi: int) -> None:
        if hi > lo and left[0] > 0 and left[1] > 0:
            self.left, self.range = np.vstack([self.left, left]), np.vstack([self.range, [lo, hi]])

    def lookup(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of pieces by length and number."""
        rows = np.array(self.rows, dtype=np.int64).reshape(-1, 5)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        key = lambda a, b: a.astype(np.uint64) << np.uint64(48) | b.astype(np.uint64)
        r = rows[np.searchsorted(key(rows[:, 0], rows[:, 1]), key(length, number), side="right") - 1]
        slot = number - r[:, 1]
        return r[:, 2] + slot // r[:, 3], r[:, 4] + slot % r[:, 3] * length


def pack(made: DataFrame, tokens: int = TOKENS, **capacities) -> DataFrame:
    """The written rows of ``encoded`` with ``sequence_id`` and ``offset`` of the first piece, and ``full_id``: the
    sequence of the first full piece; its other full pieces follow in steps of ``step``."""
    n = made.count() // ROWS_PER_BUCKET + 1
    dealt = made.select("row", "first", "full").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(n)))
    counts = dealt.where("first > 0").groupBy("bucket", "first").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(W.partitionBy("first").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).drop("n")
    # One row for each length that occurs, so fewer than a sequence has tokens.
    plan = Plan({r["first"]: r["n"] for r in counts.groupBy("first").agg(F.sum("n").alias("n")).collect()}, tokens, **capacities)
    own = W.partitionBy("bucket", "first").orderBy("row")
    before = W.partitionBy("bucket").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    dealt = dealt.withColumns({"number": F.row_number().over(own) - 1, "fulls": F.sum("full").over(before) - F.col("full")})
    dealt = dealt.join(base, ["bucket", "first"], "left").withColumn("number", F.col("number") + F.coalesce("base", F.lit(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, first, number, bucket, fulls = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
            bins, offset = np.full(len(row), -1), np.zeros(len(row), np.int64)
            some = first > 0
            if some.any():
                bins[some], offset[some] = plan.lookup(first[some], number[some])
            # Full pieces have sequences of their own, numbered within buckets.
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, bins, offset, plan.bins + bucket + n * fulls)], ["row", "sequence_id", "offset", "full_id"])

    placed = dealt.select("row", "first", "number", "bucket", "fulls").mapInArrow(place, "row long, sequence_id long, offset long, full_id long")
    return made.join(placed, "row").withColumn("step", F.lit(n).cast("long"))


def pieces(packed: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """A row for each piece: doc_id, row, piece, start, length, ids_crc32, sequence_id, offset, and ids if they were kept."""
    rows = packed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    first = (F.col("piece") == 0) & (F.col("first") > 0)
    full = F.col("piece") - F.when(F.col("first") > 0, 1).otherwise(0)  # number of the full piece
    start = F.when(first, 0).otherwise(F.col("first") + full * tokens).cast("long")
    length = F.when(first, F.col("first")).otherwise(tokens).cast("long")
    ids = {"ids": F.slice("ids", start.cast("int") + 1, length.cast("int"))} if "ids" in packed.columns else {}
    rows = rows.withColumns({"start": start, "length": length, "sequence_id": F.when(first, F.col("sequence_id")).otherwise(F.col("full_id") + full * F.col("step")), "offset": F.when(first, F.col("offset")).otherwise(0).cast("long"), **ids})
    return rows.select("doc_id", "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *ids)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, and the documents, starts and lengths of its pieces, in order; at most a sequence's tokens in a group."""
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"))


def packed_sequences(docs: DataFrame, path: str, scratch: Scratch, end: int = END, tokens: int = TOKENS, **capacities) -> DataFrame:
    """The sequences with their ids."""
    made = scratch.put(encoded(docs, path, end, tokens, ids=True), "encoded")
    return sequences(pieces(pack(made, tokens, **capacities), tokens))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Scratch(spark).put(encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)), "encoded")
    return pieces(pack(made)).drop("row")
