"""Compiling source tables into triples: id mappings, unions with membership, expression levels, code and tree prefixes,
interaction texts, and routing by predicate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedex.functions.labels import effect_key

# Sentences of interaction texts; group 1 or "se" is the effect, "mode" its direction. The first that
# matches from the start of the text decides; a sentence that would stand here twice stands once. Groups are named as Java does.
INTERACTIONS = (
    r"The risk or severity of (?<se>.*) can be (?<mode>\S+)d when .* is combined with .*",
    r".* may (?<mode>\S+) (?<se>\S+\s?\w*\s?\w*) of .* as a diagnostic agent.",
    r"The (?<se>\S+\s?\w*\s?\w*) of .* can be (?<mode>\S+)d when used in combination with .*",
    r"The (?<se>\S+\s?\w*\s?\w*) of .* can be (?<mode>\S+)d when it is combined with .*",
    r".* can cause a decrease in the absorption of .* resulting in a (?<mode>\S+) (?<se>\S+\s?\w*\s?\w*) and potentially a decrease in efficacy.",
    r".* may decrease the excretion rate of .* which could result in a (?<mode>\S+) (?<se>\S+\s?\w*\s?\w*).",
    r".* may increase the excretion rate of .* which could result in a (?<mode>\S+) (?<se>\S+\s?\w*\s?\w*) and potentially a reduction in efficacy.",
    r"The (?<se>\S+\s?\w*\s?\w*) of .* can be (?<mode>\S+)d when combined with .*",
    r".* can cause an increase in the absorption of .* resulting in an (?<mode>\S+)d (?<se>\S+\s?\w*\s?\w*) and potentially a worsening of adverse effects.",
    r"The risk of a (?<se>\S+\s?\w*\s?\w*) to .* is (?<mode>\S+)d when it is combined with .*",
    r"The (?<se>\S+\s?\w*\s?\w*) of the active metabolites of .* can be (?<mode>\S+)d when .* is used in combination with .*",
    r"The (?<se>\S+\s?\w*\s?\w*) of .*, an active metabolite of .* can be (?<mode>\S+)d when used in combination with .*",
    r".* may (?<mode>\S+) the (?<se>.*) of .*",
    r".* may (?<mode>\S+) the central nervous system depressant (?<se>\S+\s?\S*\s?\S*) of .*",
)
MODES = {"reduced": "decrease", "increase": "increase", "higher": "increase", "decrease": "decrease", "reduce": "decrease", "lower": "decrease"}
EFFECT_NAMES = {
    "central_nervous_system_depressant_(cns_depressant)_activities": "cns_depression_activities",
    "(cns_depressant)_activities": "cns_depression_activities",
    "cns_depression": "cns_depression_activities",
    "cardiotoxic_activities": "cardiotoxicity",
    "constipating_activities": "constipation",
    "excretion": "excretion_rate",
    "hyperkalemic_activities": "hyperkalemia",
    "hypertensive_activities": "hypertension",
    "qtc-prolonging_activities": "qtc_prolongation",
    "tachycardic_activities": "tachycardia",
    "hypokalemic_activities": "hypokalemia",
    "hypoglycemic_activities": "hypoglycemia",
    "hypercalcemic_activities": "hypercalcemia",
    "bradycardic_activities": "bradycardia",
    "neutropenic_activities": "neutropenia",
    "orthostatic_hypotensive_activities": "orthostatic_hypotension",
    "pseudotumor_cerebri_activities": "pseudotumor_cerebri",
    "sedative_activities": "sedation",
    "ototoxic_activities": "ototoxicity",
    "neuromuscular_blocking_activities": "neuromuscular_blockade",
    "nephrotoxic_activities": "nephrotoxicity",
    "myelosuppressive_activities": "myelosuppression",
    "hypotensive_activities": "hypotension",
    "serum_level": "serum_concentration",
}


def _lookup(names: dict, key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), other)


def _effects(text: Column, pattern: str, bare: str) -> Column:
    """The effects of a text that matches; an effect of several activities is one for each."""
    first = pattern.index("<mode>") < pattern.index("<se>")
    effect, mode = F.lower(F.regexp_extract(text, bare, 2 if first else 1)), F.regexp_extract(text, bare, 1 if first else 2)
    tail = F.when(effect.contains("activities"), "_activities").otherwise("")
    low = F.replace(effect, F.lit(" activities"), F.lit(""))
    listed = F.when(low.contains(", and"), F.split(F.replace(low, F.lit("and"), F.lit("")), ", ")).when(low.contains("and"), F.split(low, " and ")).otherwise(F.array(low))
    names = F.transform(listed, lambda x: F.concat(effect_key(x), tail))
    made = F.transform(names, lambda x: F.concat(_lookup(MODES, mode, mode), F.lit("_"), _lookup(EFFECT_NAMES, x, x)))
    if "excretion rate" in pattern:
        made = F.concat(made, F.array(F.lit(f"{'decrease' if 'decrease' in pattern else 'increase'}_excretion_rate")))
    return made


def interaction_effects(text: Column) -> Column:
    """The labelled effects (direction_effect) of an interaction text; none if no sentence matches."""
    out = F.array().cast("array<string>")
    for pattern in reversed(INTERACTIONS):
        bare = f"^{pattern.replace('?<se>', '').replace('?<mode>', '')}"
        out = F.when(text.rlike(bare), _effects(text, pattern, bare)).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def mapped(rows: DataFrame, column: str, mapping: DataFrame, keep: bool = False) -> DataFrame:
    """Rows with a column's ids replaced by all that they map to, from (old, new) rows; ``keep``: those that map to
    nothing stay as they are."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    out = rows.join(m, column, "left" if keep else "inner")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_new").select(*rows.columns)


def within(rows: DataFrame, **sets: DataFrame) -> DataFrame:
    """Rows whose columns are members of the sets (each with one column of ids)."""
    for column, ids in sets.items():
        rows = rows.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    return rows


def union_of(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def species_route(pairs: DataFrame, species: DataFrame) -> DataFrame:
    """Pairs (a, b) with the species both ends share, or OTHER; pairs with an end of unknown species go."""
    s = lambda c: species.select(F.col("id").alias(c), F.col("species").alias(f"_{c}"))
    out = pairs.join(s("a"), "a").join(s("b"), "b")
    return out.select("a", "b", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.lit("OTHER")).alias("species"))


def write_by(rows: DataFrame, column: str, path: str, allowed: Sequence[str] | None = None) -> None:
    """One folder for each value of a column; a value that is not allowed fails the write."""
    if allowed is not None:
        ok = F.col(column).isin(*allowed)
        rows = rows.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), F.col(column)))))
    rows.write.mode("overwrite").partitionBy(column).parquet(path)


def level_triples(rows: DataFrame, levels: Sequence[str]) -> DataFrame:
    """id, level, tissue, cell from (id, level, place): ``tissue__cell`` places are cut, each level has distinct rows."""
    part = F.split("place", "__")
    return rows.where(F.col("level").isin(*levels)).select("id", "level", F.get(part, 0).alias("tissue"), F.get(part, 1).alias("cell")).distinct()


def tree_prefixes(number: Column) -> Column:
    """Every dotted prefix of a tree number, itself included."""
    parts = F.split(number, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def code_levels(code: Column, lengths: Sequence[int] = (1, 3, 4, 5)) -> Column:
    """Prefixes of a classification code at its levels, and the whole code."""
    return F.array_distinct(F.array(*[F.substring(code, 1, n) for n in lengths], code))


def conflicts_out(rows: DataFrame, keys: Sequence[str], action: str, pair: tuple[str, str]) -> DataFrame:
    """Action sets of each key; where both of a contradictory pair occur, both go."""
    sets = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(action)).alias("actions"))
    both = F.array_contains("actions", pair[0]) & F.array_contains("actions", pair[1])
    left = F.when(both, F.array_except("actions", F.array(*map(F.lit, pair)))).otherwise(F.col("actions"))
    return sets.withColumn("actions", left).where(F.size("actions") > 0)


def with_references(pairs: DataFrame, known: DataFrame, reference: str) -> DataFrame:
    """Known pairs (a, b) with the sorted references found for them; pairs without a reference go."""
    hit = pairs.join(known, ["a", "b"], "left_semi").where(F.col(reference).isNotNull())
    return hit.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set(reference)), ",").alias("references"))


def consistent_sites(text: Column) -> tuple[Column, Column]:
    """Name and site of ``name(site)``; null where the text has another shape."""
    p = r"^([^()]+)\(([^()]+)\)$"
    got = lambda i: F.when(text.rlike(p), F.regexp_extract(text, p, i))
    return got(1), got(2)


def records(lines: DataFrame) -> DataFrame:
    """id, tag, value of flat-file records (column ``value`` holds one record): lines of a two-letter tag, three blanks
    and a value; the id is the first word of the ID line."""
    at = F.split("value", "\n")
    rows = lines.select(F.regexp_extract("value", r"(?m)^ID\s+(\S+)", 1).alias("id"), F.posexplode(at).alias("line", "x"))
    rows = rows.where(F.col("x").rlike(r"^[A-Z]{2}   \S") & (F.col("id") != ""))
    return rows.select("id", "line", F.substring("x", 1, 2).alias("tag"), F.trim(F.substring("x", 6, 1 << 20)).alias("value"))


def clamped_date(year: Column, month: Column, day: Column) -> Column:
    """A date from parts that may be missing, named or out of range: month names count, the rest is clamped."""
    low = F.lower(F.substring(F.coalesce(month, F.lit("")), 1, 3))
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13), strict=True) for x in kv]), low)
    m = F.greatest(F.lit(1), F.least(F.lit(12), F.coalesce(named, month.try_cast("int"), F.lit(1))))
    first = F.make_date(year, m, F.lit(1))
    d = F.greatest(F.lit(1), F.least(F.dayofmonth(F.last_day(first)), F.coalesce(day.try_cast("int"), F.lit(1))))
    return F.date_add(first, d - 1)
