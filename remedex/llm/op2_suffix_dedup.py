"""Suffix-array dedup: remove bytes covered by a 100-byte string that also starts earlier.

Sorting the suffixes of a whole corpus would move a row for every byte.  Only suffixes that can have an equal are
sorted here.  Every string of ``LENGTH`` bytes selects one of its k-grams, the leftmost of least hash; equal strings
select equal grams at equal offsets.  So:

1. Each document gives its selected grams, each with the range of strings that select it (about one for 38 bytes).  A
   gram that occurs once in the corpus has no equal strings, and goes.  Occurrences whose whole ranges are equal are a
   class: all but the first are covered.
2. Classes of one gram that differ (at the edges of passages, and around edits) meet with their bytes, and the suffixes
   at their strings are sorted to a depth of ``LENGTH``: deep-shallow sorting, with multikey quicksort to ``SHALLOW``
   bytes, and blind tries for the groups that are still equal there.  Equal suffixes are neighbours then, and all but
   the first of each group are covered.
3. The covered ranges of a document are merged and cut out.

A task marks the later copies of a class that it has seen itself, and these meet nothing again, so a passage of a third of
the rows costs one row for each task.  A gram with more than ``HOT`` classes is not brought to one task: its strings are
dealt by their own hash and the equal ones are met in order, as a stream.  What a task sorts at once is bounded by
``STRINGS``.

Order is by (doc_id, start).  Hashes of grams and of ranges are 64-bit values that must both agree.  Both are polynomials modulo
2 ** 64 behind a finaliser; the strings that such polynomials are known to confuse have 1,024 bytes and more, ranges below 230.

Defined cases: a null text is empty; texts below ``LENGTH`` bytes stay whole; rows of one doc_id are copies of one
document, which do not remove each other, and all lose the ranges found for it, as far as they reach (if their texts
differ, strings are compared in the least text); null ids count as one id before all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedex.llm.common import ByteHash, Scratch, concat, mix, release, slices, small_batches, table

NAME = "op2_suffix_dedup"
LENGTH, GRAM, SHALLOW = 100, 24, 32
HOT, STRINGS = 4_000, 160_000
NO_ID = -(1 << 63)
_PLACE = np.uint64((1 << 30) - 1)


def selected(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, ByteHash]:
    """Text number, gram place, and first and last string start of every selected gram of the texts in a buffer."""
    hashes = ByteHash(buf)
    n = len(buf)
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none, none, none, none, hashes
    at = np.arange(n - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    # The place makes the leftmost of equal grams the least; places of a buffer stay below 2 ** 30.
    low = (grams & ~_PLACE) | at.astype(np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while have < width:  # least of ``have`` neighbours, doubled until the width is reached
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    choice = (low & _PLACE).astype(np.int64)
    start = np.arange(len(choice))
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = start + LENGTH <= bounds[text + 1]
    choice, start, text = choice[inside], start[inside], text[inside]
    if not len(start):
        return none, none, none, none, hashes
    new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return text[first], choice[first], start[first], start[last], hashes


def anchors(docs: DataFrame) -> DataFrame:
    """gram, whole (hashes), doc_id and place (start << 14 | strings << 7 | offset) of every selected gram.

    ``known`` rows are covered by a row of the same task; their gram is a number that no other row is likely to have.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode(errors="surrogatepass") for t in b["text"]]
            ids = b["doc_id"].to_numpy()
            for lo, hi in slices([len(t) for t in texts], 2 << 20):
                buf, bounds = concat(texts[lo:hi])
                text, gram, first, last, hashes = selected(buf, bounds)
                if not len(text):
                    continue
                strings, offset, doc = last - first, gram - first, ids[lo:hi][text]
                place = (first - bounds[text]) << 14 | strings << 7 | offset
                with np.errstate(over="ignore"):
                    whole = hashes.of(first, last + LENGTH) * np.uint64(0x9E3779B97F4A7C15) + (strings << 7 | offset).astype(np.uint64)
                key = hashes.of(gram, gram + GRAM)
                order = np.lexsort((place, doc, whole, key))
                key, whole, doc, place = key[order], whole[order], doc[order], place[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])])
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                stay = new | (doc != doc[head]) | (place != place[head])  # the rest are rows of a repeated document
                own = mix(mix(key + doc.astype(np.uint64)) + place.astype(np.uint64))
                made = {"gram": np.where(new, key, own).view(np.int64), "whole": whole.view(np.int64), "doc_id": doc, "place": place, "known": ~new}
                yield pd.DataFrame({k: v[stay] for k, v in made.items()})

    return docs.mapInPandas(run, "gram long, whole long, doc_id long, place long, known boolean")


def _span(start, strings) -> list:
    return [start.cast("bigint").alias("start"), (start + strings + LENGTH).cast("bigint").alias("end")]


def meet(found: DataFrame) -> DataFrame:
    """Rows of ``anchors`` that matter: covered (not the first of their class), or the first of one of several classes."""
    own = W.partitionBy("gram", "whole").orderBy("doc_id", "place")
    rows = found.withColumns({
        "rank": F.row_number().over(own),
        "first_doc": F.first("doc_id").over(own),
        "first_place": F.first("place").over(own),
    })
    both = W.partitionBy("gram").orderBy("whole").rangeBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("several", F.min("whole").over(both) != F.max("whole").over(both))
    same = (F.col("doc_id") == F.col("first_doc")) & (F.col("place") == F.col("first_place"))
    rows = rows.withColumn("covered", F.col("known") | ~same).where(F.col("covered") | ((F.col("rank") == 1) & F.col("several")))
    return rows.select("gram", "doc_id", "place", "covered")


# ---------------------------------------------------------------- deep-shallow sorting


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one big-endian number."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf), dtype=np.uint64)
    for i in range(8):
        out |= padded[i : i + len(buf)] << np.uint64(56 - 8 * i)
    return out


def _regroup(order: np.ndarray, group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members sorted within their groups by the keys, and the numbers of the smaller groups that they form."""
    by = np.lexsort((*reversed(keys), group))
    new = np.zeros(len(by), dtype=bool)
    for k in (group, *keys):
        s = k[by]
        new[1:] |= s[1:] != s[:-1]
    return order[by], np.cumsum(new)


def _tied(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of groups of two or more."""
    size = np.bincount(group)
    keep = size[group] > 1
    return order[keep], group[keep]


def shallow(words: np.ndarray, starts: np.ndarray, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and groups that are still tied at ``SHALLOW`` bytes, by multikey quicksort.

    A round parts every group in three around the character (eight bytes) of its middle member: the smaller and the
    larger ones stay at their depth, the equal ones go on to the next character.
    """
    depth = np.zeros(len(order), dtype=np.int64)
    done, n = [(order[:0], group[:0])], 0
    while len(order):
        deep = depth >= SHALLOW
        done.append((order[deep], group[deep] + n))
        n += int(group[-1]) + 1
        order, group, depth = order[~deep], group[~deep], depth[~deep]
        if not len(order):
            break
        char = words[starts[order] + depth]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        pivot = np.repeat(char[first + size // 2], size)
        side = np.where(char < pivot, 0, np.where(char == pivot, 1, 2))
        key = group * 3 + side
        by = np.argsort(key, kind="stable")
        key, order, depth = key[by], order[by], (depth + 8 * (side == 1))[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(new) - 1
        tied = np.bincount(number)[number] > 1
        order, group, depth = order[tied], number[tied], depth[tied]
    return np.concatenate([x for x, _ in done]), np.unique(np.concatenate([x for _, x in done]), return_inverse=True)[1]


def equal_suffixes(buf: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each suffix the number of the first suffix of its group that agrees with it in ``LENGTH`` bytes.

    Members of a group are in order of occurrence, and groups are numbered in the order of their members.
    """
    words = _words(buf)
    same = np.arange(len(starts))
    order, group = shallow(words, starts, *_tied(np.arange(len(starts)), group))
    # Blind tries: a group's first member is the trunk; every other member leaves it at its first different byte, and
    # those that leave at one place by one byte form a subtree, which is handled the same way.  No bytes before the
    # branch are read again, as all members of the subtree agree there.
    steps = [*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8]
    while len(order):
        new = np.concatenate([[True], group[1:] != group[:-1]])
        trunk = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        lcp, branch, other = (np.full(len(order), v, dtype=np.int64) for v in (LENGTH, 0, 0))
        todo = np.flatnonzero(~new)
        for d in steps:
            a, b = words[starts[order[todo]] + d], words[starts[trunk[todo]] + d]
            x = a ^ b
            hit = np.flatnonzero(x)
            zero = 7 - np.floor(np.log2(x[hit].astype(np.float64) + 0.5)).astype(np.int64) // 8
            zero = np.clip(zero, 0, 7)
            # Rounding may be off by one byte for numbers close to a power of two.
            shift = (np.uint64(56) - zero.astype(np.uint64) * np.uint64(8))
            off = (x[hit] >> shift) == 0
            zero[off] += 1
            big = (x[hit] >> np.minimum(shift + np.uint64(8), np.uint64(63))) != 0
            zero[big & (zero > 0)] -= 1
            lcp[todo[hit]] = d + zero
            down = np.uint64(56) - zero.astype(np.uint64) * np.uint64(8)
            branch[todo[hit]] = (a[hit] >> down & np.uint64(255)).astype(np.int64)
            other[todo[hit]] = (b[hit] >> down & np.uint64(255)).astype(np.int64)
            todo = np.delete(todo, hit)
        whole = lcp >= LENGTH
        same[order[whole]] = trunk[whole]
        left = ~whole
        side = np.where(branch < other, 0, 1)  # before or after the trunk in the order of suffixes
        order, group = _tied(*_regroup(order[left], group[left], side[left], np.where(side[left] == 0, lcp[left], -lcp[left]), branch[left]))
    return same


# ---------------------------------------------------------------- strings of differing classes


def contexts(docs: DataFrame, variants: DataFrame, hot: DataFrame) -> DataFrame:
    """The bytes of the classes that differ: (gram, window, doc_id, start, strings, offset, bytes).

    ``window`` is 0 and the bytes hold the whole range; of hot grams each string has a row, and ``window`` is its hash.
    """
    marked = variants.join(hot.withColumn("hot", F.lit(True)), "gram", "left")
    per_doc = marked.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("found"))  # bounded by the document's length
    rows = docs.groupBy("doc_id").agg(F.min("text").alias("text")).join(per_doc, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, found in zip(b["doc_id"], b["text"], b["found"], strict=True):
                data = text.encode(errors="surrogatepass")
                buf = np.frombuffer(data, np.uint8)
                hashes = None
                for f in found:
                    gram, place = f["gram"], f["place"]
                    start, strings, offset = place >> 14, place >> 7 & 127, place & 127
                    if start + strings + LENGTH > len(data):
                        continue  # of a longer text under the same id
                    if not f["hot"]:
                        out.append((gram, 0, doc, start, strings, offset, data[start : start + strings + LENGTH]))
                        continue
                    hashes = hashes or ByteHash(buf)
                    for s in range(start, start + strings + 1):
                        out.append((gram, int(hashes.of(np.array([s]), np.array([s + LENGTH])).view(np.int64)[0]) | 1, doc, s, 0, offset - (s - start), data[s : s + LENGTH]))
            if out:
                yield pd.DataFrame(out, columns=["gram", "window", "doc_id", "start", "strings", "offset", "bytes"])

    return rows.select("doc_id", "text", "found").mapInPandas(run, "gram long, window long, doc_id long, start long, strings int, offset int, bytes binary")


def covered_strings(rows: DataFrame) -> DataFrame:
    """doc_id, start, end of the ranges that later equal strings cover, from the rows of ``contexts``."""

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        buf, bounds = concat(list(b["bytes"]))
        strings = b["strings"].to_numpy().astype(np.int64) + 1
        row = np.repeat(np.arange(len(b)), strings)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
        new = (b["gram"].to_numpy()[1:] != b["gram"].to_numpy()[:-1]) | (b["window"].to_numpy()[1:] != b["window"].to_numpy()[:-1])
        group = np.concatenate([[0], np.cumsum(new)])[row] * 128 + b["offset"].to_numpy()[row] - shift
        order = np.argsort(group, kind="stable")
        same = np.arange(len(row))
        _, dense = np.unique(group[order], return_inverse=True)
        same[order] = order[equal_suffixes(buf, (bounds[row] + shift)[order], dense)]
        doc, start = b["doc_id"].to_numpy(), b["start"].to_numpy()
        at = start[row] + shift
        hit = np.flatnonzero((same != np.arange(len(row))) & ~((doc[row[same]] == doc[row]) & (at[same] == at)))
        if not len(hit):
            return pd.DataFrame({"doc_id": [], "start": [], "end": []}, dtype="int64")
        cut = np.concatenate([[True], (row[hit][1:] != row[hit][:-1]) | (shift[hit][1:] != shift[hit][:-1] + 1)])
        first = hit[cut]
        last = hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
        return pd.DataFrame({"doc_id": doc[row[first]], "start": at[first], "end": at[last] + LENGTH})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            key = b["gram"].to_numpy() != b["gram"].iloc[-1]
            key |= b["window"].to_numpy() != b["window"].iloc[-1]
            whole = int(np.flatnonzero(key)[-1]) + 1 if key.any() else 0
            size = np.cumsum(b["strings"].to_numpy() + 1)
            if (whole == 0 or size[whole - 1] < STRINGS) and size[-1] < 2 * STRINGS:
                held = b
                continue
            if not whole or b["window"].iloc[-1]:
                # Equal strings of a hot gram (or a gram at the bound of HOT) that fill the buffer: all met so far are
                # solved, and the first of each is kept for those to come.
                yield solve(b)
                tail = b.iloc[whole:]
                held = tail.drop_duplicates(subset=["bytes", "strings", "offset"]).reset_index(drop=True)
            else:
                yield solve(b.iloc[:whole])
                held = b.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    keys = ["gram", "window"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id", "start").mapInPandas(run, "doc_id long, start long, end long")


def spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and spans: the maximal covered ranges of every document that has any."""
    spark = docs.sparkSession
    small_batches(spark)
    found = scratch.put(meet(anchors(docs)), "found")
    release(spark)
    variants = found.where("NOT covered").select("gram", "doc_id", "place")
    hot = scratch.put(variants.groupBy("gram").count().where(F.col("count") > HOT).select("gram"), "hot")
    strings = scratch.put(covered_strings(contexts(docs, variants, hot)), "strings")
    release(spark)
    start, count = F.shiftright("place", 14), F.shiftright("place", 7).bitwiseAND(F.lit(127))
    ranges = found.where("covered").select("doc_id", *_span(start, count)).unionByName(strings)
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "end"))),  # bounded by the document's length
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return ranges.groupBy("doc_id").agg(merged.alias("spans"))


def _kept(data: bytes, found) -> tuple[bytes, int, int]:
    """What is left of the bytes, the number of bytes removed, and of runs."""
    if found is None or not len(found):
        return data, 0, 0
    out, at, gone, runs = [], 0, 0, 0
    for s in found:
        a, b = s["start"], min(s["end"], len(data))
        if a < b:
            out.append(data[at:a])
            at, gone, runs = b, gone + b - a, runs + 1
    out.append(data[at:])
    return b"".join(out), gone, runs


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _id():
    return F.coalesce("doc_id", F.lit(NO_ID))


def removal(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = _rows(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, found in zip(b["doc_id"], b["text"], b["spans"], strict=True):
                data = text.encode(errors="surrogatepass")
                kept, gone, runs = _kept(data, found)
                out.append((doc, len(data), gone, runs, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = rows.join(spans(rows, scratch), "doc_id", "left").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def cut_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with the covered bytes cut out of their text; one that is covered whole stays as an empty text.

    Bytes of a character that was cut in the middle go too, so that the text stays valid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column("_text"), b.column("_spans")
            out = []
            for text, spans_ in zip(texts, found, strict=True):
                data = text.as_py()
                out.append(None if data is None else _kept(data, spans_.as_py())[0].decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(out, pa.string())], ["_row", "_text"])

    # Documents that lose nothing stay within the JVM.
    found = spans(_rows(docs), scratch).select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    rows = docs.select(_id().alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).join(found, "_id", "left")
    rows = scratch.put(rows, "marked")
    cut = rows.where("_spans IS NOT NULL").select("_row", F.col("_row.text").cast("binary").alias("_text"), "_spans")
    cut = cut.mapInArrow(run, T.StructType([cut.schema["_row"], T.StructField("_text", T.StringType())]))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    cut = cut.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
    return rows.where("_spans IS NULL").select("_row.*").unionByName(cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"), Scratch(spark))
