"""A store of vectors as an inverted index: rows lie in the cell of their nearest codeword, one folder for each cell.

Upserts and evictions write anew the cells that they touch and no others; the manifest names the current batch of each cell, its
size, and the widest angle of its rows from the codeword.  A search probes the cells nearest to the query first.  By the angles, no row of
a cell can be nearer than a bound; cells whose bound reaches the k-th score found are probed after, so the result is exact
however few cells were probed at first.  Cells and queries are dealt to blocks of bounded size; a pair of blocks is one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.sources.batches import Batches

SAMPLE = 20_000  # vectors that a codebook is fitted on, by hash of the id
ROWS, QUERIES = 1 << 19, 1 << 17  # numbers of a block of rows, and of one of queries; each holds about so many


def codebook(vectors: DataFrame, cells: int, seed: int = 1) -> np.ndarray:
    """Unit codewords by k-means over a bounded sample of the unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors.where(F.size("vector") > 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(_unit(F.col("vector")).alias("v")).where("v IS NOT NULL")
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample.select(array_to_vector("v").alias("features")))
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


def _unit(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class VectorStore:
    """Rows (id, owner, section, vector, payload, added): ids are unique, owners are evicted whole, oldest first."""

    COLUMNS = "id string, owner string, section string, vector array<double>, payload string, added long, angle double"

    def __init__(self, spark: SparkSession, path: str, words: np.ndarray):
        self.spark, self.words = spark, words
        self.batches = Batches(spark, path, f"{self.COLUMNS}, cell int", "cell int, rows long, angle double", ["cell"])

    def cells(self) -> DataFrame:
        """cell, batch, rows, angle of the cells that hold rows."""
        last = self.batches.manifest().groupBy("cell").agg(F.max_by(F.struct("batch", "rows", "angle"), "number").alias("b"))
        return last.select("cell", "b.*").where("rows > 0")

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows of some cells, or of all; other folders are not read."""
        held = self.cells().collect()  # one row for each cell
        held = [r for r in held if cells is None or r["cell"] in set(cells)]
        if not held:
            return self.spark.createDataFrame([], self.batches.schema).drop("batch")
        by: dict[str, list[int]] = {}
        for r in held:
            by.setdefault(r["batch"], []).append(r["cell"])
        wanted = F.lit(False)
        for batch, own in by.items():
            wanted = wanted | ((F.col("batch") == batch) & F.col("cell").isin(own))
        return self.batches.read(list(by)).where(wanted).drop("batch")

    def _placed(self, rows: DataFrame) -> DataFrame:
        words = self.words

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.array(b["unit"].tolist()).reshape(len(b), -1)
                cos = x @ words.T
                cell = cos.argmax(1)
                yield b.drop(columns="unit").assign(angle=np.arccos(np.clip(cos[np.arange(len(b)), cell], -1, 1)), cell=cell.astype(np.int32))

        # Added may be large, but is never null here; all other columns are text or arrays.
        kept = rows.select(F.col("id").cast("string"), F.col("owner").cast("string"), F.col("section").cast("string"), F.col("vector").cast("array<double>"), F.col("payload").cast("string"), F.col("added").cast("long"), _unit(F.col("vector")).alias("unit"))
        return kept.where("unit IS NOT NULL AND id IS NOT NULL").mapInPandas(near, f"{self.COLUMNS}, cell int")

    def _rewrite(self, touched: list[int], rows: DataFrame) -> None:
        """New contents of the touched cells, in one commit."""
        batch = self.batches.write(rows)
        found = {r["cell"]: r for r in self.batches.read([batch]).groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle")).collect()}  # one row for each cell
        facts = [(c, found[c]["rows"] if c in found else 0, found[c]["angle"] if c in found else 0.0) for c in touched]
        if facts:
            self.batches.commit(batch, self.batches.number(), facts)

    def upsert(self, rows: DataFrame) -> list[int]:
        """Add rows or replace those of their ids; gives the cells written. Of rows with one id that added last counts; rows
        without an id, or with a zero vector or none, are left out."""
        from remedex.sources.settle import settled

        last = F.row_number().over(W.partitionBy("id").orderBy(F.col("added").desc(), F.xxhash64("vector", "payload")))
        first = rows.na.fill(0, ["added"]).withColumn("_n", last).where("_n = 1").drop("_n")
        new = settled(self._placed(first))
        old = self.rows()
        moved = old.join(new.select("id"), "id", "left_semi").select("cell")
        touched = sorted(r["cell"] for r in new.select("cell").union(moved).distinct().collect())  # at most one row for each cell
        self._rewrite(touched, self.rows(touched).join(new.select("id"), "id", "left_anti").unionByName(new))
        return touched

    def delete(self, gone: Column) -> list[int]:
        """Drop the rows that meet a condition; gives the cells written."""
        touched = sorted(r["cell"] for r in self.rows().where(gone).select("cell").distinct().collect())  # at most one row for each cell
        if touched:
            self._rewrite(touched, self.rows(touched).where(~F.coalesce(gone, F.lit(False))))
        return touched

    def evict(self, most: int) -> list[str]:
        """Drop the owners that were added first until ``most`` are left; gives them. An owner's place is that of its first row."""
        order = W.orderBy(F.col("at").desc(), "owner")
        owners = self.rows().groupBy("owner").agg(F.min("added").alias("at"))
        kept = owners.orderBy(F.col("at").desc(), "owner").limit(most)
        gone = [r["owner"] for r in owners.join(kept.select("owner"), "owner", "left_anti").withColumn("n", F.row_number().over(order)).orderBy("n").collect()]  # few: a store is capped at each write
        if gone:
            self.delete(F.col("owner").isin(gone))
        return gone

    def search(self, queries: DataFrame, top: int, probes: int = 4, weight: Column | None = None, where: Column | None = None, most_weight: float = 1.0) -> DataFrame:
        """query, id, owner, section, payload, score, rank: the rows nearest to each query (query, vector) by cosine times a weight.

        ``where`` filters rows; ``most_weight`` is the largest value that the weight can have. Null or zero queries have no rows.
        """
        from remedex.sources.settle import Steps, settled

        words = [[float(x) for x in w] for w in self.words]
        held = self.cells().collect()  # one row for each cell
        book = self.spark.createDataFrame([(r["cell"], words[r["cell"]], r["angle"]) for r in held], "cell int, word array<double>, angle double")
        with Steps(self.spark) as steps:
            asked = steps.put(queries.select("query", _unit(F.col("vector")).alias("q")).where("q IS NOT NULL"))
            # A row's angle to the query is at least that of its codeword less the widest angle of the cell.
            off = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(F.col("q"), F.col("word")))))
            bound = F.when(off > F.col("angle"), F.cos(off - F.col("angle"))).otherwise(F.lit(1.0)) + 1e-9
            bound = F.when(bound > 0, bound * most_weight).otherwise(F.lit(1e-9))
            pairs = asked.crossJoin(F.broadcast(book)).select("query", "q", "cell", off.alias("off"), bound.alias("bound"))  # a stated query set against the codebook
            order = F.row_number().over(W.partitionBy("query").orderBy("off", "cell"))
            pairs = steps.put(pairs.withColumn("n", order))
            n = asked.count()
            first = steps.put(self._scored(pairs.where(F.col("n") <= probes).withColumn("floor", F.lit(None).cast("double")), top, weight, where, n))
            floor = first.where(F.col("rank") == top).select("query", F.col("score").alias("floor"))
            rest = pairs.where(F.col("n") > probes).join(floor, "query", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
            more = self._scored(rest, top, weight, where, n)
            found = steps.put(_best(first.drop("rank").unionByName(more.drop("rank")), top))
            rows = self.rows().select("id", "owner", "section", "payload")
            return settled(found.join(rows, "id").select("query", "id", "owner", "section", "payload", "score", "rank"))

    def _scored(self, pairs: DataFrame, top: int, weight: Column | None, where: Column | None, asked: int) -> DataFrame:
        """query, id, score, rank: the best rows of the cells that each query is paired with (query, q, cell, floor)."""
        cells = sorted(r["cell"] for r in pairs.select("cell").distinct().collect())  # at most one row for each cell
        rows = self.rows(cells)
        if where is not None:
            rows = rows.where(where)
        dims = self.words.shape[1]
        sizes = [(r["cell"], -(-r["rows"] * dims // ROWS)) for r in self.cells().collect()]  # one row for each cell
        blocks = F.broadcast(self.spark.createDataFrame(sizes, "cell int, blocks long"))
        parts = max(1, -(-asked * dims // QUERIES))
        part = lambda key, n: F.pmod(F.xxhash64(key), n)
        weight = F.lit(1.0) if weight is None else weight
        left = pairs.where(F.size("q") == dims).join(blocks, "cell").select("query", "q", "floor", "cell", part("query", F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        right = rows.join(blocks, "cell").select("id", _unit(F.col("vector")).alias("unit"), weight.cast("double").alias("weight"), "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), part("id", F.col("blocks")).alias("block"))
        kind = pairs.schema["query"].dataType.simpleString()

        def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            found = [] if q.empty or r.empty else [best_of(i, f, x, r["id"].to_numpy(), rows, w, top) for i, f, x, rows, w in _blocks(q, r)]
            return pd.concat(found) if found else pd.DataFrame({"query": q["query"].iloc[:0], "id": [], "score": []})

        by = ["cell", "part", "block"]
        return _best(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, f"query {kind}, id string, score double"), top)


def _blocks(q: pd.DataFrame, r: pd.DataFrame) -> Iterator[tuple]:
    """Runs of queries, each with all rows of the block."""
    rows, weight = np.array(r["unit"].tolist(), dtype=float), r["weight"].to_numpy(float)
    for at in range(0, len(q), 256):
        some = q.iloc[at : at + 256]
        yield some["query"], some["floor"].fillna(-np.inf).to_numpy(float), np.array(some["q"].tolist(), dtype=float), rows, weight


def best_of(queries: pd.Series, floor: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, weight: np.ndarray, top: int) -> pd.DataFrame:
    """query, id, score: the ``top`` rows of each query from its floor on, by score (NaN first) and then id.

    The product of the matrices only says which rows may be among them. Their scores are then added up in the order of the components, so
    equal vectors have equal scores in any block.
    """
    near = q @ rows.T * weight
    near[np.isnan(near)] = np.inf
    least = floor if len(ids) <= top else np.maximum(floor, np.partition(near, len(ids) - top, axis=1)[:, len(ids) - top])
    found = []
    for i in range(len(q)):
        own = np.flatnonzero(near[i] >= least[i] - 1e-9 * max(1.0, abs(least[i]) if np.isfinite(least[i]) else 1.0))
        score = np.add.accumulate(rows[own] * q[i], axis=1)[:, -1] * weight[own]
        high = np.where(np.isnan(score), np.inf, score)
        first = [k for k in np.lexsort((ids[own].astype(str), -high))[:top] if high[k] >= floor[i]]
        found.append(pd.DataFrame({"query": [queries.iloc[i]] * len(first), "id": ids[own][first], "score": score[first]}))
    return pd.concat(found)


def _best(rows: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)
