"""A table of statements that holds each of them once, however often and in whatever parts they are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.sources.batches import Batches


class StatementTable:
    """Statements of a schema, unique over all writes.

    Rows lie in folders by the hash of all their columns. A write anti-joins its distinct rows with those of the same folders, writes
    what is left as a batch and commits it; so a write that is run again, or overlaps an earlier one, adds nothing twice.
    The number of folders is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, folders: int = 16):
        self.columns = spark.createDataFrame([], schema).columns
        self.folders = folders
        self.batches = Batches(spark, path, f"{schema}, _hash long, _folder int", "rows long", ["_folder"])

    def _placed(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), f"`{c}`") for c in self.columns])
        return rows.select(*[f"`{c}`" for c in self.columns], h.alias("_hash")).withColumn("_folder", F.pmod("_hash", F.lit(self.folders)).cast("int"))

    def write(self, rows: DataFrame) -> int:
        """Add the rows that are not there; gives their number."""
        new = self._placed(rows).distinct().alias("n")
        if not self.batches.manifest().isEmpty():
            old = self.batches.read().alias("o")
            same = [F.col("n._folder") == F.col("o._folder"), F.col("n._hash") == F.col("o._hash"), *[F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in self.columns]]
            new = new.join(old, reduce(lambda a, b: a & b, same), "left_anti")
        batch = self.batches.write(new.repartition("_folder"))
        n = self.batches.read([batch]).count()
        if n:
            self.batches.commit(batch, self.batches.number(), [(n,)])
        return n

    def read(self) -> DataFrame:
        return self.batches.read().select(*[f"`{c}`" for c in self.columns])
