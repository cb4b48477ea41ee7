"""Scores that were computed before, by the version of the graph and by seed.

A request anti-joins its seeds with the manifest, computes those that are missing together, appends them as one batch, and reads the
folders of the batches that hold its seeds and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.sources.batches import Batches


def graph_version(edges: DataFrame, **options) -> str:
    """A name for a set of edges (src, dst, relation) and the options of its scores, whatever the order of the rows."""
    h = F.xxhash64("src", "dst", "relation").cast("decimal(38, 0)")
    h2 = F.xxhash64("relation", "dst", "src", F.lit("second")).cast("decimal(38, 0)")
    n, a, b = edges.agg(F.count("*"), F.sum(h), F.sum(h2)).first()
    text = "|".join([str(n), str(a), str(b), *(f"{k}={options[k]!r}" for k in sorted(options))])
    return uuid.uuid5(uuid.NAMESPACE_OID, text).hex


class ScoreCache:
    """Scores (seed, id, p) below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.batches = Batches(spark, path, "seed string, id string, p double", "version string, seed string")

    def known(self, version: str) -> DataFrame:
        """seed, number, batch of the seeds that have scores; of a seed that two runs computed at once one batch counts."""
        own = self.batches.manifest().where(F.col("version") == version)
        return own.groupBy("seed").agg(F.min(F.struct("number", "batch")).alias("b")).select("seed", "b.*")

    def missing(self, version: str, seeds: Sequence[str]) -> list[str]:
        """The asked seeds that have no scores, in order."""
        asked = self.spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "seed string")
        return sorted(r["seed"] for r in asked.join(self.known(version), "seed", "left_anti").collect())  # at most the stated seeds

    def scores(self, version: str, seeds: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """seed, id, p and number (of the batch that computed them) for the asked seeds.

        ``compute`` takes seeds (seed, id, p) and gives seed, id, p; it is called once, for the missing ones.
        """
        new = self.missing(version, seeds)
        if new:
            start = self.spark.createDataFrame([(s, s, 1.0) for s in new], "seed string, id string, p double")
            batch = self.batches.write(compute(start).select("seed", "id", "p").sortWithinPartitions("seed", "id"))
            self.batches.commit(batch, self.batches.number(), [(version, s) for s in new])
        held = self.known(version).where(F.col("seed").isin(list(seeds)))
        batches = sorted({r["batch"] for r in held.select("batch").distinct().collect()})  # one for each earlier request at most
        kept = self.batches.read(batches).where(F.col("seed").isin(list(seeds)))
        return kept.join(F.broadcast(held), ["seed", "batch"]).select("seed", "id", "p", "number")  # one row for each stated seed
