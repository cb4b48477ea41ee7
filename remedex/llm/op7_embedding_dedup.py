"""Embedding near-duplicates by an inverted multi-index.

Independent codebooks on the two halves of the unit vectors form a product grid.  Every vector visits its nearest cells
in the order of the multi-sequence traversal; how many is set so that a pair at the very threshold shares a cell with
the target recall, measured on sampled vectors, with neighbours made at that cosine and with the links among them.  Vectors that share a cell are
compared in double precision.  A pair that meets in several cells is counted in the first of its common cells, so all
counts are exact for the pairs found, and the same from both sides.

Equal vectors are one class with a count from the start.  Cells above ``CELL`` members are split into blocks and each
pair of blocks is a group of its own, so no task holds more than two blocks; nothing is capped.  Of the links within a
group only counts and a spanning forest leave it.

Codebooks are fitted on a bounded sample (``SAMPLE`` vectors by their hash) and have a fixed number of rows for a
number of vectors; they alone go to all tasks.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing (n_links 0, own
component, kept); vectors of different length do not link; equal ids are separate rows of one class by vector; a null id
links like others and names a component only if all its ids are null (its rows are then kept); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.llm.common import Scratch, small_batches, table
from remedex.llm.components import components

NAME = "op7_embedding_dedup"
COSINE, RECALL = 0.9, 0.97
SAMPLE, PROBES, PER_CELL, CELL = 16_384, 2_000, 12, 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codebook of the rows of x by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def traverse(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The first cells of the multi-sequence traversal for each row: those of least sum of half distances.

    A cell is among the first ``visits`` only if its two codewords are among the nearest ``visits`` of their halves.
    """
    half = x.shape[1] // 2
    best = []
    for part, book in ((x[:, :half], books[0]), (x[:, half:], books[1])):
        d = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
        order = np.argsort(d, axis=1, kind="stable")[:, :visits]
        best.append((order, np.take_along_axis(d, order, axis=1)))
    (i, di), (j, dj) = best
    total = (di[:, :, None] + dj[:, None, :]).reshape(len(x), -1)
    visits = min(visits, total.shape[1])
    first = np.argpartition(total, visits - 1, axis=1)[:, :visits]
    return np.sort(np.take_along_axis(i, first // j.shape[1], 1) * len(books[1]) + np.take_along_axis(j, first % j.shape[1], 1), axis=1).astype(np.int32)


def fit(sample: np.ndarray, vectors: int, cosine: float, recall: float) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Codebooks, and the number of cells to visit for the target recall at the threshold."""
    k = int(min(1024, max(2, math.ceil(math.sqrt(vectors / PER_CELL)))))
    half = sample.shape[1] // 2
    books = (kmeans(sample[:, :half], k), kmeans(sample[:, half:], k, seed=8))
    rng = np.random.default_rng(9)
    x = sample[:PROBES]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    norm = np.linalg.norm(noise, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(1 - cosine**2) * noise / np.where(norm > 0, norm, 1)
    # Pairs of the sample that are links, as vectors near one another need not differ in all directions alike.
    i, j = np.nonzero(x @ sample.T >= cosine)
    i, j = i[i != j], j[i != j]
    some = rng.permutation(len(i))[:PROBES]
    pairs = [(x, y), (x[i[some]], sample[j[some]])][: 2 if len(some) else 1]
    visits, most = 1, len(books[0]) * len(books[1])
    while visits < most:
        met = [np.mean([bool(np.intersect1d(p, q, assume_unique=True).size) for p, q in zip(traverse(a, books, visits), traverse(b, books, visits), strict=True)]) for a, b in pairs]
        if min(met) >= recall:
            break
        visits = min(most, max(visits + 1, visits * 5 // 4))
    return books, visits


def _unit(raw: pd.Series, dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        scale = np.abs(x).max(1, keepdims=True)  # keeps very large and very small vectors in range
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def place(classes: DataFrame, books, visits: int, dim: int, kind: str) -> DataFrame:
    """rep, n, vec and visits (binary), and the cell, for each cell that a vector visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = traverse(_unit(b["vec"], dim, kind), books, visits)
            k = cells.shape[1]
            at = np.repeat(np.arange(len(b)), k)
            out = b.iloc[at].reset_index(drop=True)
            raw = [c.tobytes() for c in cells]
            out["visits"] = [raw[i] for i in at]
            out["cell"] = cells.ravel()
            yield out

    return classes.select("rep", "n", "vec").mapInPandas(run, "rep long, n long, vec binary, visits binary, cell int")


def links(placed: DataFrame, dim: int, kind: str, cosine: float) -> DataFrame:
    """rep, n_links, to: links of a vector in one group, and the least vector of its component there."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    rows = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("rep", "n", "vec", "visits", "cell", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compare(key, b: pd.DataFrame) -> pd.DataFrame:
        cell, lo, hi = key
        # The two sides are the blocks lo and hi; within one block each pair is seen once.
        x = _unit(b["vec"], dim, kind)
        first = np.flatnonzero(b["block"].to_numpy() == lo)
        second = first if lo == hi else np.flatnonzero(b["block"].to_numpy() == hi)
        i, j = np.nonzero(x[first] @ x[second].T >= cosine)
        i, j = first[i], second[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return pd.DataFrame({"rep": [], "n_links": [], "to": []}).astype("int64")
        seen = np.frombuffer(b"".join(b["visits"]), dtype=np.int32).reshape(len(b), -1)
        here = np.ones(len(i), dtype=bool)
        for c in range(seen.shape[1]):  # a smaller cell that both visit has the pair already
            left = seen[i, c]
            here &= ~((left < cell) & (seen[j] == left[:, None]).any(1))
        i, j = i[here], j[here]
        n, rep = b["n"].to_numpy(), b["rep"].to_numpy()
        count = np.bincount(i, n[j], len(b)) + np.bincount(j, n[i], len(b))
        to = rep.copy()
        while True:
            least = to.copy()
            np.minimum.at(least, i, to[j])
            np.minimum.at(least, j, to[i])
            if (least == to).all():
                break
            to = least
        hit = np.unique(np.concatenate([i, j]))
        return pd.DataFrame({"rep": rep[hit], "n_links": count[hit].astype(np.int64), "to": to[hit]})

    return rows.groupBy("cell", "lo", "hi").applyInPandas(compare, "rep long, n_links long, to long")


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    small_batches(vectors.sparkSession)
    kind = "<f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "<f8"
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", F.when(good & finite, F.transform("embedding", lambda v: v + F.lit(0).cast("float" if kind == "<f4" else "double"))).alias("v"))
    # Classes of equal vectors have numbers of their own, as ids may be null.
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = scratch.put(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rep": b["rep"], "n": b["n"], "least": b["least"], "vec": [np.asarray(v, dtype=kind).tobytes() for v in b["v"]]})

    found = []
    for dim, count in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # one row for each length of vector
        own = classes.where(F.size("v") == dim).select("rep", "n", F.coalesce("least", F.lit(-1 << 63)).alias("least"), "v").mapInPandas(pack, "rep long, n long, least long, vec binary")
        sample = own.select("vec", "least").orderBy(F.xxhash64("least"), "least", "vec").limit(SAMPLE).toPandas()  # a bounded sample for the codebooks
        unit = _unit(sample["vec"], dim, kind)
        if dim == 1:
            unit, own = np.hstack([unit, np.zeros_like(unit)]), own.withColumn("vec", F.expr(f"concat(vec, cast(repeat(chr(0), {int(kind[2])}) as binary))"))
        books, visits = fit(unit, count, cosine, recall)
        found.append(links(place(own, books, visits, max(dim, 2), kind), max(dim, 2), kind, cosine))
    if found:
        linked = scratch.put(reduce(DataFrame.unionByName, found), "links")
        sums = linked.groupBy("rep").agg(F.sum("n_links").alias("sum"))
        named = components(linked.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch).select(F.col("node").alias("rep"), "component")
        classes = classes.join(sums, "rep", "left").join(named, "rep", "left")
    else:
        classes = classes.withColumns({"sum": F.lit(0), "component": F.col("rep")})
    classes = classes.withColumn("component", F.coalesce("component", "rep"))
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = classes.join(ids, "component").select("v", (F.coalesce("sum", F.lit(0)) + F.col("n") - 1).alias("links"), F.col("component_id").alias("component"), F.lit(True).alias("linked"))
    # Rows of a class that holds a third of the table are dealt over salts, and its one fact row is repeated for each.
    salts = 16
    left = rows.withColumn("salt", F.when(F.col("v").isNotNull(), F.pmod(F.xxhash64("vec_id"), F.lit(salts))))
    right = facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    out = left.join(right, ["v", "salt"], "left")
    component = F.when(F.col("linked"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scratch)
