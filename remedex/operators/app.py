"""Application queries: paged lists, children, roll-ups of JSON results, progress, latest steps, job states, merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A job moves forward only.
STATES = ("queued", "running", "completed", "failed")


def searched(df: DataFrame, columns: Sequence[str], text: str | None) -> DataFrame:
    """Rows in which any of the columns holds the text, ignoring case; no text: all rows."""
    if not text:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower())) for c in columns]))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of the rows, with their total and the number of pages."""
    total = df.agg(F.count("*").alias("total"))  # one row
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size).cast("bigint"))


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children, key, "left_semi")


def json_sum(df: DataFrame, by: str, column: str, path: str) -> DataFrame:
    """Sum of a number (or of the length of a list) at a path of JSON texts; what is neither counts as 0."""
    got = F.get_json_object(column, path)
    n = F.coalesce(got.try_cast("double"), F.json_array_length(got).cast("double"), F.lit(0.0))
    return df.groupBy(by).agg(F.sum(n).alias("total"), F.count("*").alias("n"))


def progress(items: DataFrame, jobs: DataFrame, key: str, percent: dict[str, int]) -> DataFrame:
    """Items with the percent of their job's status, or their own where they have no job."""
    m = F.create_map(*[F.lit(x) for kv in percent.items() for x in kv])
    return items.join(jobs.select(key, "status"), key, "left").withColumn("percent", F.coalesce(F.try_element_at(m, F.coalesce("status", F.lit(""))), "percent"))


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group."""
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_l")).select(*by, "_l.*")


def job_states(log: DataFrame, stale: Column | None = None) -> DataFrame:
    """The state of each job of a status log (job, status, ts): the furthest of its latest time; jobs that ``stale``
    holds for and that did not end have failed."""
    order = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    last = log.withColumn("_o", order).groupBy("job").agg(F.max_by("status", F.struct("ts", "_o")).alias("status"), F.max("ts").alias("ts"), F.count("*").alias("changes"))
    if stale is None:
        return last
    return last.withColumn("status", F.when(F.col("status").isin("queued", "running") & stale, "failed").otherwise(F.col("status")))


def trail(messages: DataFrame, by: str, order: str, wanted: Column, text: str) -> DataFrame:
    """The texts of wanted messages of each session, in order; a session's length bounds the list."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return messages.where(wanted).groupBy(by).agg(F.transform(listed, lambda x: x["t"]).alias("trail"))


def merged_state(outputs: DataFrame, session: str, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """session, key, value: the last value that an agent allowed to write the key gave, from (session, agent, ts, key, value)."""
    ok = reduce(lambda a, b: a | b, [(F.col("agent") == a) & F.col("key").isin(*keys) for a, keys in allowed.items()])
    return outputs.where(ok).groupBy(session, "key").agg(F.max_by("value", F.struct("ts", "agent")).alias("value"))


def fresh(cache: DataFrame, created: str, now: Column, days: int) -> DataFrame:
    """Cached rows that are still valid."""
    return cache.where(F.col(created) >= F.date_sub(now, days))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost by kind, and over all kinds."""
    out = calls.rollup("kind").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.grouping_id().alias("_g"))
    return out.withColumn("kind", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("kind"))).drop("_g")


def decoded(text: Column) -> Column:
    """A text column as JSON where it is valid JSON; null otherwise."""
    return F.try_parse_json(text)


def latest_per_branch(steps: DataFrame) -> DataFrame:
    """The step of largest index of each (session, branch)."""
    rank = F.row_number().over(W.partitionBy("session", "branch").orderBy(F.col("index").desc()))
    return steps.withColumn("_n", rank).where("_n = 1").drop("_n")
