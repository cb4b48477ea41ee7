"""Answers kept by key, with an age limit and a limit to their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.sources.batches import Batches


class KeyedCache:
    """key, value, created, used: each change is a merge that writes the state anew, commits it and drops the one before.

    ``days``: an entry is fresh on the day it was made and so many days after, as days are counted by date. ``most``: of more
    entries those that were used least recently go. Either may be left out.
    """

    def __init__(self, spark: SparkSession, path: str, days: int | None = None, most: int | None = None):
        self.days, self.most = days, most
        self.batches = Batches(spark, path, "key string, value string, created timestamp, used timestamp", "size long")

    def state(self) -> DataFrame:
        """All entries, those past their age too, until a merge drops them."""
        return self.batches.read().drop("batch")

    def _fresh(self, now: Column) -> Column:
        return F.lit(True) if self.days is None else F.to_date("created") >= F.date_sub(F.to_date(now), self.days)

    def get(self, keys: DataFrame, now) -> DataFrame:
        """key, value of the fresh entries among the asked ones (column ``key``); they count as used now."""
        asked, now = keys.select("key").distinct(), F.lit(now)
        state = self.state()
        hit = state.join(asked.withColumn("_asked", F.lit(True)), "key", "left")
        used = F.when(F.col("_asked") & self._fresh(now), F.greatest("used", now)).otherwise(F.col("used"))
        self._write(hit.withColumn("used", used).drop("_asked"), now)
        return self.state().join(asked, "key", "left_semi").where(self._fresh(now)).select("key", "value")

    def put(self, rows: DataFrame, now) -> None:
        """Add or replace entries (key, value); of rows with one key the one of greatest value counts."""
        now = F.lit(now)
        new = rows.groupBy("key").agg(F.max("value").alias("value")).withColumns({"created": now, "used": now})
        self._write(self.state().join(new, "key", "left_anti").unionByName(new), now)

    def _write(self, rows: DataFrame, now: Column) -> None:
        rows = rows.where(self._fresh(now)).select("key", "value", F.col("created").cast("timestamp"), F.col("used").cast("timestamp"))
        if self.most is not None:
            rows = rows.orderBy(F.col("used").desc(), F.col("created").desc(), "key").limit(self.most)
        batch = self.batches.write(rows)
        self.batches.commit(batch, self.batches.number(), [(self.batches.read([batch]).count(),)])
        self.batches.only(batch)

    def last_used(self, n: int) -> DataFrame:
        """The entries used last, newest first."""
        order = W.orderBy(F.col("used").desc(), F.col("created").desc(), "key")
        return self.state().orderBy(F.col("used").desc(), F.col("created").desc(), "key").limit(n).withColumn("rank", F.row_number().over(order))  # of ``n`` rows
