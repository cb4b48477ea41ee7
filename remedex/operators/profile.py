"""Profiles of candidates: baselines per criterion, normalised and weighted scores, record merging and gates.

Criteria are kept in long form (id, criterion, number, category), so one aggregation gives all statistics and one join
with the small table of criteria gives all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def long_form(df: DataFrame, id_: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """id, criterion, number, category: a row for each value; blanks and what is no number are null."""
    parts = [F.struct(F.lit(c).alias("criterion"), F.col(c).cast("string").try_cast("double").alias("number"), F.lit(None).cast("string").alias("category")) for c in numeric]
    parts += [F.struct(F.lit(c).alias("criterion"), F.lit(None).cast("double").alias("number"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("category")) for c in categorical]
    return df.select(F.col(id_).alias("id"), F.explode(F.array(*parts)).alias("v")).select("id", "v.*")


def baselines(values: DataFrame) -> DataFrame:
    """Per criterion: count, coverage, extremes, median and quartiles (linear interpolation), and whether it tells
    candidates apart."""
    x = F.col("number")
    out = values.groupBy("criterion").agg(
        F.count("*").alias("total"),
        F.count(F.coalesce(x.cast("string"), F.col("category"))).alias("n"),
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        F.percentile(x, 0.5).alias("median"),
        F.percentile(x, 0.25).alias("p25"),
        F.percentile(x, 0.75).alias("p75"),
        F.count_distinct("category").alias("kinds"),
    )
    return out.withColumns({"coverage": F.col("n") / F.col("total"), "discriminating": F.coalesce(F.col("hi") > F.col("lo"), F.col("kinds") > 1)})


def histogram(values: DataFrame) -> DataFrame:
    return values.where("category IS NOT NULL").groupBy("criterion", "category").agg(F.count("*").alias("n"))


def overridden(base: DataFrame, points: DataFrame) -> DataFrame:
    """Baselines with the bounds of ``points`` (criterion, p25, p75) in their place; a one-sided bound keeps the other."""
    own = points.select("criterion", F.col("p25").alias("_lo"), F.col("p75").alias("_hi"))
    return base.join(own, "criterion", "left").withColumns({"p25": F.coalesce("_lo", "p25"), "p75": F.coalesce("_hi", "p75")}).drop("_lo", "_hi")


def normalised(values: DataFrame, base: DataFrame, criteria: DataFrame, unmapped: float = 0.5) -> DataFrame:
    """Adds weight and norm in [0, 1]: place between the quartiles (flipped where less is better), or the category's
    score; where the quartiles agree, 1 for their value and 0 for others.  ``criteria`` has criterion, weight, lower, scores.
    """
    joined = values.join(base.select("criterion", "p25", "p75"), "criterion").join(criteria, "criterion")
    span = F.col("p75") - F.col("p25")
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("number") - F.col("p25")) / F.when(span != 0, span)))
    place = F.when(F.col("lower"), 1 - place).otherwise(place)
    exact = F.when(F.col("number") == F.col("p25"), 1.0).otherwise(0.0)
    number = F.when(F.col("number").isNotNull(), F.when(span == 0, exact).otherwise(place))
    mapped = F.coalesce(F.try_element_at("scores", F.coalesce("category", F.lit(""))), F.lit(unmapped))
    norm = F.when(F.col("category").isNotNull(), mapped).otherwise(number)
    return joined.select("id", "criterion", "weight", norm.alias("norm"))


def composite(norms: DataFrame) -> DataFrame:
    """Score out of 100 over the weights that have data, completeness, and the criteria without data."""
    used = F.when(F.col("norm").isNotNull(), F.col("weight"))
    out = norms.groupBy("id").agg(
        F.sum(F.col("norm") * F.col("weight")).alias("_s"),
        F.sum(used).alias("used"),
        F.sum("weight").alias("available"),
        F.array_sort(F.collect_list(F.when(F.col("norm").isNull(), F.col("criterion")))).alias("missing"),
    )
    return out.select("id", (100 * F.col("_s") / F.col("used")).alias("score"), (F.coalesce("used", F.lit(0)) / F.col("available")).alias("completeness"), "missing")


def drivers(norms: DataFrame, top: int = 3) -> DataFrame:
    """The criteria that add most to each score."""
    gain = norms.withColumn("gain", F.col("norm") * F.col("weight")).where("gain > 0")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("gain").desc(), "criterion"))
    return gain.withColumn("rank", rank).where(F.col("rank") <= top).select("id", "criterion", "gain", "rank")


def weights_by_alias(given: DataFrame, aliases: DataFrame) -> DataFrame:
    """criterion, weight and problem of a table of weights whose names are matched by letters and digits only."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    known = aliases.groupBy(key("alias").alias("_k")).agg(F.min("criterion").alias("criterion"))
    out = given.withColumn("_k", key("name")).join(known, "_k", "left")
    problem = F.when(F.col("criterion").isNull(), "unknown").when(F.col("weight") < 0, "negative")
    return out.select("name", "criterion", "weight", problem.alias("problem"))


def effective_weights(weights: DataFrame, hidden: Column, total: int = 100) -> DataFrame:
    """Whole weights that add up to ``total`` over the criteria that are not hidden: floors first, and what is missing
    goes to the largest fractions, earlier criteria first.  The table of criteria is small by nature."""
    left = weights.where(~hidden)
    sums = left.agg(F.sum("weight").alias("_t"))  # one row
    scaled = left.crossJoin(sums).withColumn("_x", F.col("weight") * total / F.col("_t"))
    scaled = scaled.withColumns({"_f": F.floor("_x"), "_r": F.round(F.col("_x") - F.floor("_x"), 9)})
    rest = F.lit(total) - F.sum("_f").over(W.partitionBy(F.lit(1)))
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("_r").desc(), "ord"))
    return scaled.select("criterion", (F.col("_f") + F.when(rank <= rest, 1).otherwise(0)).cast("int").alias("weight"))


def merged_records(records: DataFrame, key: Column, priority: Column, fields: Sequence[str], preferred: Sequence[str] = (), source: str = "source", prefer: str = "") -> DataFrame:
    """One record for each key: every field is the first value by priority, but ``preferred`` fields come from the
    source ``prefer`` where it has one.  Also the number of records and the sources that gave them."""
    rows = records.withColumns({"_key": key, "_p": priority})
    first = lambda c, p: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), p))
    own = F.struct((F.col(source) != prefer).alias("later"), F.col("_p").alias("p"))
    plain = F.struct(F.lit(False).alias("later"), F.col("_p").alias("p"))
    agg = [first(c, own if c in preferred else plain).alias(c) for c in fields]
    return rows.groupBy(F.col("_key").alias("key")).agg(*agg, F.count("*").alias("records"), F.array_sort(F.collect_set(source)).alias("sources"))


def best_potency(rows: DataFrame, molecule: str, value: str, units: str) -> DataFrame:
    """The least value in nM of each molecule; one that has none stays with null."""
    return rows.groupBy(molecule).agg(F.min(F.when(F.col(units) == "nM", F.col(value))).alias("best"), F.count("*").alias("n"))


def universe(molecules: DataFrame, phase: str, id_: str, least: float, limit: int) -> DataFrame:
    """The furthest developed molecules of a phase or more; of a molecule's rows the furthest, and of equal ones the least."""
    order = W.partitionBy(id_).orderBy(F.col(phase).desc(), *[c for c in molecules.columns if c not in (id_, phase)])
    first = molecules.where(F.col(phase) >= least).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.orderBy(F.col(phase).desc(), id_).limit(limit)


def descendants(parents: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Roots (id) and all below them, from (child, parent) rows, to a depth."""
    seen = front = roots.select("id").distinct()
    for _ in range(depth):
        front = parents.join(front.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id")).distinct()
        seen = seen.unionByName(front).distinct()
    return seen


def excluded(candidates: DataFrame, indications: DataFrame, diseases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates without an indication (id, disease) among the diseases (id), and the others with those indications."""
    hit = indications.join(diseases.select(F.col("id").alias("disease")), "disease", "left_semi")
    why = hit.groupBy("id").agg(F.array_sort(F.collect_set("disease")).alias("diseases"))
    return candidates.join(why, "id", "left_anti"), candidates.join(why, "id")


def two_phase(scores: DataFrame, gains: DataFrame, enrich: int, top: int) -> DataFrame:
    """A cheap ranking; the first ``enrich`` get the gain of (id, gain) rows, then all are ranked again."""
    order = lambda c: [F.col(c).desc(), F.col("id")]
    head = scores.orderBy(*order("score")).limit(enrich).select("id").join(gains, "id")
    out = scores.join(head, "id", "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0)))
    return out.withColumn("enriched", F.col("gain").isNotNull()).drop("gain").orderBy(*order("score")).limit(top)
