"""Reading the tables of a folder, and registering those that a statement names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt to all tasks by a key. The few row groups of a small table are few tasks, however costly each row is; and
    without a number adaptive execution would put small shuffles together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the tables of a folder. Only tables that the text names are registered."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)
