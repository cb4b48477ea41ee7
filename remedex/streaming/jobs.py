"""Streams of application events: windowed counts with a watermark, deduplicated events, and a table of job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from remedex.operators.app import STATES
from remedex.sources.settle import delete, settled


def read_events(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """Events as their files land. Times without a zone are taken in the session's zone, as watermarks need."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, the group, its events and the sum of their values for each window; later events are dropped."""
    w = F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each event once, though it may be sent again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_states(events: DataFrame, job: str, status: Column) -> DataFrame:
    """The last state of each job so far (output mode ``update``): one row of state for each job."""
    order = F.array_position(F.array(*map(F.lit, STATES)), F.col("_s"))
    last = F.max(F.struct("ts", order.alias("o"), F.col("_s").alias("status")))
    return events.withColumn("_s", status).groupBy(job).agg(last.alias("l")).select(job, "l.status", "l.ts")


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is there, and stop; a restart goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_to(df: DataFrame, keys: list[str], path: str, checkpoint: str, folders: int = 32) -> StreamingQuery:
    """Keep the rows of an ``update`` stream as a table of one row a key, read by ``read_upserted``.

    Rows lie in folders by the hash of their keys. A batch writes anew the folders that its keys touch, then the list of the current
    version of every folder, and drops folders that neither this list nor the one before names; so a batch that is run again
    gives the same table, and its cost grows with the folders touched.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, path, n - 1) if n else {}
        placed = settled(batch.withColumn("_folder", F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")))
        touched = [r["_folder"] for r in placed.select("_folder").distinct().collect()]  # at most one for each folder
        old = [f"{path}/data/v{versions[f]}/_folder={f}" for f in touched if f in versions]
        if old:
            kept = spark.read.schema(batch.schema).parquet(*old)
            kept = kept.withColumn("_folder", F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int"))
            placed = placed.unionByName(kept.join(placed.select(*keys), keys, "left_anti"))
        placed.repartition("_folder").write.mode("overwrite").partitionBy("_folder").parquet(f"{path}/data/v{n}")
        now = versions | dict.fromkeys(touched, n)
        spark.createDataFrame(sorted(now.items()), "folder int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/state/v{n}")
        for f, v in (_versions(spark, path, n - 2) if n > 1 else {}).items():
            if versions.get(f) != v:  # the batch before this one has replaced it, and cannot run again
                delete(spark, f"{path}/data/v{v}/_folder={f}")

    return df.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    return {r["folder"]: r["version"] for r in spark.read.parquet(f"{path}/state/v{n}").collect()}  # one row for each folder


def read_upserted(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The table of ``upsert_to`` after a batch."""
    return spark.read.parquet(*[f"{path}/data/v{v}/_folder={f}" for f, v in sorted(_versions(spark, path, batch).items())])
