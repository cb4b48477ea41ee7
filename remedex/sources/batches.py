"""Tables that grow by batches: each is written to a folder of its own and counts only when the manifest names it.

A write that fails, or whose task ran twice, leaves nothing that is read.  Readers name the folders of the batches that they want, so
others are not listed in a scan.  One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.sources.settle import delete


class Batches:
    """Rows of a schema below a folder, with a manifest of a schema of its own (a batch may have several rows there)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, facts: str, by: Sequence[str] = ()):
        self.spark, self.path, self.by = spark, path.rstrip("/"), list(by)
        self.schema, self.facts = f"{schema}, batch string", f"batch string, number long, {facts}"

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.facts).parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], self.facts)

    def number(self) -> int:
        """The number of the next batch."""
        return (self.manifest().agg(F.max("number")).first()[0] or 0) + 1

    def write(self, rows: DataFrame) -> str:
        """Write rows as a batch that does not count yet."""
        batch = uuid.uuid4().hex
        rows.write.partitionBy(*self.by).parquet(f"{self.path}/data/batch={batch}")
        return batch

    def commit(self, batch: str, number: int, facts: Sequence[tuple] = ((),)) -> None:
        """Name a batch in the manifest; from now on it counts."""
        self.spark.createDataFrame([(batch, number, *f) for f in facts], self.facts).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self, batches: Sequence[str] | None = None) -> DataFrame:
        """Rows of some batches, or of all that count."""
        if batches is None:
            batches = sorted({r["batch"] for r in self.manifest().select("batch").distinct().collect()})  # one for each write
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data").where(F.col("batch").isin(list(batches)))

    def only(self, batch: str) -> None:
        """Leave one batch: the manifest names no other, then the other folders go."""
        rows = self.manifest().collect()  # one for each write
        mine = [r for r in rows if r["batch"] == batch]
        self.spark.createDataFrame(mine, self.facts).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")
        for old in {r["batch"] for r in rows} - {batch}:
            delete(self.spark, f"{self.path}/data/batch={old}")
