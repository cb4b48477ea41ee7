"""Screening: docking logs, best poses, boxes, interaction tables and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_rows(lines: DataFrame) -> DataFrame:
    """mode and affinity of the result lines of docking logs (column ``value``); other columns stay."""
    hit = lines.where(F.col("value").rlike(r"^\s*\d+\s+[-+]?\d+\.\d+"))
    part = F.split(F.trim("value"), r"\s+")
    return hit.withColumns({"mode": F.get(part, 0).try_cast("int"), "affinity": F.get(part, 1).try_cast("double")}).drop("value")


def best_poses(rows: DataFrame, by: list[str], affinity: str, ties: list[str]) -> DataFrame:
    """The pose of least affinity of each group. Poses are reduced before the shuffle by a partial aggregate."""
    others = [c for c in rows.columns if c not in by]
    order = F.struct(F.col(affinity), *map(F.col, ties))
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("_b"))
    return best.select(*by, "_b.*")


def top_fraction(best: DataFrame, affinity: str, ties: list[str], fraction: float, per: str | None = None) -> DataFrame:
    """The first max(floor(n * fraction), 1) rows by affinity, of all or of each group."""
    if per:
        n = F.count("*").over(W.partitionBy(per))
        rank = F.row_number().over(W.partitionBy(per).orderBy(affinity, *ties))
        return best.withColumns({"rank": rank, "_n": n}).where(F.col("rank") <= F.greatest(F.floor(F.col("_n") * fraction), F.lit(1))).drop("_n")
    n = best.count()
    head = best.orderBy(affinity, *ties).limit(max(int(n * fraction), 1))
    return head.withColumn("rank", F.row_number().over(W.orderBy(affinity, *ties)))


def box(atoms: DataFrame, by: str, pad: float = 8.0, least: float = 20.0, most: float = 40.0) -> DataFrame:
    """Centre and size of the padded box around the atoms (x, y, z) of each structure, sizes within bounds."""
    agg = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    out = atoms.groupBy(by).agg(*agg)
    cols: dict[str, Column] = {}
    for c in "xyz":
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        cols[f"centre_{c}"] = F.round((lo + hi) / 2, 3)
        cols[f"size_{c}"] = F.round(F.greatest(F.lit(least), F.least(F.lit(most), hi - lo + 2 * pad)), 3)
    return out.select(by, *[v.alias(k) for k, v in cols.items()])


def atoms(lines: DataFrame) -> DataFrame:
    """Fixed-width atom lines (column ``value``) as record, residue, chain, x, y, z; other columns stay."""
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    hit = lines.where(F.substring("value", 1, 6).rlike("^(ATOM  |HETATM)"))
    got = {"record": cut(1, 6), "residue": cut(18, 3), "chain": cut(22, 1), "x": cut(31, 8).try_cast("double"), "y": cut(39, 8).try_cast("double"), "z": cut(47, 8).try_cast("double")}
    return hit.withColumns(got).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").drop("value")


def largest_ligand(found: DataFrame, by: str, solvents: tuple[str, ...] = ("HOH", "WAT", "DOD", "SO4", "GOL", "EDO")) -> DataFrame:
    """The hetero group with most atoms of each structure, solvents left out."""
    n = found.where((F.col("record") == "HETATM") & ~F.col("residue").isin(*solvents)).groupBy(by, "residue", "chain").agg(F.count("*").alias("n"))
    best = n.groupBy(by).agg(F.max_by(F.struct("residue", "chain", "n"), F.struct("n", "residue", "chain")).alias("b"))
    return best.select(by, "b.*")


def poses(lines: DataFrame, by: str, line: str) -> DataFrame:
    """Adds the number of the model block that each line of a file belongs to."""
    model = F.sum(F.when(F.col("value").rlike(r"^MODEL\b"), 1).otherwise(0)).over(W.partitionBy(by).orderBy(line))
    return lines.withColumn("pose", model).where("pose > 0")


def melted(wide: DataFrame, ids: list[str], flags: list[str]) -> DataFrame:
    """ids, flag of the true flags of a wide table."""
    long = wide.unpivot(ids, flags, "flag", "hit")
    return long.where("hit").drop("hit")


def roll_up(long: DataFrame, by: str) -> DataFrame:
    return long.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by)


def batch(proteins: DataFrame, drugs: DataFrame, most: int = 200) -> DataFrame:
    """All combinations of two short lists; more than ``most`` are refused before anything is combined."""
    n = proteins.limit(most + 1).count() * drugs.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{n} combinations or more; at most {most} are allowed")
    return proteins.join(F.broadcast(drugs))  # at most ``most`` rows


def status_split(rows: DataFrame, status: str, affinity: str) -> DataFrame:
    """Adds ``failed``, and ranks the rows that did not fail within each protein; failures stay without a rank."""
    failed = F.coalesce(F.col(status), F.lit("")).startswith("Failed")
    value = F.coalesce(F.col(affinity).try_cast("double"), F.lit(0.0))
    marked = rows.withColumns({"failed": failed, "_a": value})
    rank = F.row_number().over(W.partitionBy("protein", "failed").orderBy("_a", "ligand"))
    return marked.withColumn("rank", F.when(~F.col("failed"), rank)).drop("_a")


def choices_named(text: Column) -> Column:
    """(id, title) pairs of a message such as ``1ABC (first title); 2XYZ (second title)``."""
    ids = F.regexp_extract_all(text, F.lit(r"\b([0-9][A-Z0-9]{3}) \(([^)]*)\)"), 1)
    titles = F.regexp_extract_all(text, F.lit(r"\b([0-9][A-Z0-9]{3}) \(([^)]*)\)"), 2)
    return F.arrays_zip(ids.alias("id"), titles.alias("title"))
