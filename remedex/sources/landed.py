"""Landed JSON: manifests of runs, appended records, tables written anew or declared, and nested columns made flat."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from remedex.sources.settle import settled

MANIFEST = "run_id string, status string, combinations long, proteins array<struct<protein_name: string>>, _broken string"


def run_manifests(spark: SparkSession, path: str, name: str = "manifest.json") -> DataFrame:
    """run_id, status, combinations, proteins, modified of the runs below a folder, newest first; broken files are left
    out, and a run without an id has its folder's name."""
    options = {"multiLine": "true", "recursiveFileLookup": "true", "pathGlobFilter": name, "columnNameOfCorruptRecord": "_broken"}
    df = spark.read.options(**options).schema(MANIFEST).json(path).select("*", "_metadata.file_path", F.col("_metadata.file_modification_time").alias("modified"))
    folder = F.url_decode(F.regexp_extract("file_path", "([^/]+)/[^/]+$", 1))
    out = df.where("_broken IS NULL").select(F.coalesce("run_id", folder).alias("run_id"), "status", "combinations", F.col("proteins.protein_name").alias("proteins"), "modified")
    return out.orderBy(F.col("modified").desc(), "run_id")


def append_json(df: DataFrame, path: str) -> None:
    """Append rows to a folder of JSON lines."""
    df.write.mode("append").json(path)


def overwrite_rows(df: DataFrame, path: str, placeholder: DataFrame | None = None) -> None:
    """Write a table anew; if there are no rows, the placeholder's. The rows are computed once, before the old ones go."""
    out = settled(df)
    (placeholder if placeholder is not None and out.isEmpty() else out).write.mode("overwrite").parquet(path)


def update_json(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the rows of the same keys in a folder of JSON lines, and add the others."""
    try:
        old = settled(df.sparkSession.read.schema(df.schema).json(path).join(df.select(*keys), keys, "left_anti"))
    except AnalysisException:  # nothing was written yet
        old = df.limit(0)
    old.unionByName(df).write.mode("overwrite").json(path)


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested fields as columns named by their path; arrays stay as they are."""

    def leaves(schema: StructType, path: tuple[str, ...]):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select([F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, ())])


def flat_entries(df: DataFrame, sep: str = "_") -> DataFrame:
    """Adds ``flat``: a map from path to value (as text) of all nested fields, the items of arrays by their number."""
    pairs = "array<struct<key: string, value: string>>"

    def entries(value: Column, kind: DataType, path: Column) -> Column:
        if isinstance(kind, StructType):
            fields = [entries(value[f.name], f.dataType, F.concat_ws(sep, path, F.lit(f.name))) for f in kind.fields]
            return F.concat(*fields) if fields else F.array().cast(pairs)
        if isinstance(kind, ArrayType):
            items = F.transform(value, lambda x, i: entries(x, kind.elementType, F.concat_ws(sep, path, i.cast("string"))))
            return F.coalesce(F.flatten(items), F.array().cast(pairs))
        return F.array(F.struct(path.alias("key"), value.cast("string").alias("value")))

    every = [entries(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in df.schema.fields]
    return df.withColumn("flat", F.map_from_entries(_first_of_key(F.concat(*every))))


def _first_of_key(entries: Column) -> Column:
    """Entries of which ``a.b`` and ``a_b`` may have the same key: the first stays."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)


def materialised(spark: SparkSession, path: str, tables: dict[str, Callable[..., DataFrame]]) -> dict[str, DataFrame]:
    """Writes declared tables anew, each after those that its function names as arguments, and gives them as they were
    written. Tables that wait for each other are refused."""
    done: dict[str, DataFrame] = {}
    wants = {k: list(inspect.signature(f).parameters) for k, f in tables.items()}
    while len(done) < len(tables):
        ready = [k for k in tables if k not in done and all(w in done for w in wants[k])]
        if not ready:
            raise ValueError(f"tables wait for each other or for unknown ones: {sorted(set(tables) - set(done))}")
        for k in ready:
            tables[k](**{w: done[w] for w in wants[k]}).write.mode("overwrite").parquet(f"{path}/{k}")
            done[k] = spark.read.parquet(f"{path}/{k}")
    return done
