"""Landed source files as triples: flat records, link lists, tables behind a preamble, piped fields, XML entries,
and the links of proteins, chemicals, complexes and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.functions.labels import effect_key
from remedex.operators.compile import records


def read_records(spark: SparkSession, path: str, end: str = "//\n") -> DataFrame:
    """id, line, tag, value of flat files whose records end with a line of their own; each file is split by records."""
    return records(spark.read.option("lineSep", end).text(path))


def record_triples(rows: DataFrame, tags: dict[str, str], split: str = ";") -> DataFrame:
    """source, edge_type, target of the lines of named tags, one for each part of a value."""
    kind = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    parts = F.filter(F.transform(F.split("value", split), lambda x: F.trim(x)), lambda x: x != "")
    return rows.where(F.col("tag").isin(*tags)).select(F.col("id").alias("source"), F.element_at(kind, F.col("tag")).alias("edge_type"), F.explode(parts).alias("target")).distinct()


def link_triples(rows: DataFrame, left: str, right: str, predicates: dict[tuple[str, str], str]) -> DataFrame:
    """Links of prefixed ids (``kind:id``), named by the pair of their kinds; pairs without a name are left out."""
    kind = lambda c: F.substring_index(c, ":", 1)
    own = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    names = F.create_map(*[F.lit(x) for (a, b), name in predicates.items() for x in (f"{a}|{b}", name)])
    name = F.try_element_at(names, F.concat_ws("|", kind(F.col(left)), kind(F.col(right))))
    return rows.select(own(F.col(left)).alias("source"), name.alias("edge_type"), own(F.col(right)).alias("target")).where("edge_type IS NOT NULL").distinct()


def after_header(lines: DataFrame, names: Sequence[str], sep: str = "\t") -> DataFrame:
    """The named columns of lines (file, line, value) that follow the header line; what stands before it is left out."""
    parts = F.split("value", sep)
    head = lines.where(F.array_contains(parts, names[0]) & F.array_contains(parts, names[-1]))
    head = head.groupBy("file").agg(F.min_by(F.struct("line", parts.alias("columns")), "line").alias("h"))  # one row a file
    body = lines.join(F.broadcast(head), "file").where(F.col("line") > F.col("h.line"))
    value = lambda n: F.get(parts, (F.array_position("h.columns", n) - 1).cast("int"))
    return body.select(*[value(n).alias(n) for n in names])


def piped(rows: DataFrame, column: str) -> DataFrame:
    """A row for each part of a piped field."""
    parts = F.filter(F.transform(F.split(column, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn(column, F.explode(parts))


def turned(rows: DataFrame, flip: Column) -> DataFrame:
    """Triples with their ends exchanged where a condition holds, as for child to parent relations."""
    a, b = F.col("source"), F.col("target")
    return rows.select(F.when(flip, b).otherwise(a).alias("source"), "edge_type", F.when(flip, a).otherwise(b).alias("target"))


def read_entries(spark: SparkSession, path: str, tag: str, schema) -> DataFrame:
    """Elements of large XML files, one a row, read in splits."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def protein_links(rows: DataFrame, known: DataFrame) -> DataFrame:
    """source, edge_type, target, references of interactions (a, b, refs) between proteins that ``known`` (source, target)
    holds. The publications of a pair's rows are put together; a pair without any is left out."""
    own = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(2))
    both = rows.where(F.col("a").startswith("uniprot") & F.col("b").startswith("uniprot"))
    both = both.select(own("a").alias("source"), own("b").alias("target"), F.explode(F.split("refs", r"\|")).alias("ref"))
    both = both.where(F.col("ref").startswith("pubmed")).withColumn("ref", F.split_part("ref", F.lit(":"), F.lit(2)))
    both = both.where(~F.col("ref").startswith("unassigned") & (F.col("ref") != "")).join(known.select("source", "target").distinct(), ["source", "target"], "left_semi")
    out = both.groupBy("source", "target").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("references"))
    return out.select("source", F.lit("INTERACTS_WITH").alias("edge_type"), "target", "references")


def chemical_actions(rows: DataFrame, chemicals: DataFrame, genes: DataFrame) -> DataFrame:
    """source, edge_type, target, references of chemical and gene rows (chemical, gene, actions, refs).

    ``chemicals`` (chemical, drug) and ``genes`` (gene, protein) give the ids, one row for each. A process that a pair both
    increases and decreases keeps neither; AFFECTS stays in any case. Actions are ``effect^process`` parted by ``|``.
    """
    used = rows.join(chemicals.select("chemical").distinct(), "chemical", "left_semi").join(genes.select("gene").distinct(), "gene", "left_semi")
    part = used.select("chemical", "gene", "refs", F.explode(F.split(F.upper("actions"), r"\|")).alias("action"))
    part = part.select("chemical", "gene", F.split_part("action", F.lit("^"), F.lit(1)).alias("effect"), effect_key(F.split_part("action", F.lit("^"), F.lit(2))).alias("process"), F.explode(F.split("refs", r"\|")).alias("ref"))
    refs = {e: F.collect_set(F.when(F.col("effect") == e, F.col("ref"))) for e in ("AFFECTS", "INCREASES", "DECREASES")}
    sums = part.groupBy("chemical", "gene", "process").agg(*[v.alias(k) for k, v in refs.items()])
    torn = (F.size("INCREASES") > 0) & (F.size("DECREASES") > 0)
    kinds = F.array(*[F.struct(F.lit(e).alias("effect"), F.col(e).alias("refs")) for e in refs])
    kinds = F.filter(kinds, lambda k: (F.size(k["refs"]) > 0) & (~torn | (k["effect"] == "AFFECTS")))
    out = sums.select("chemical", "gene", "process", F.explode(kinds).alias("k")).join(chemicals.distinct(), "chemical").join(genes.distinct(), "gene")
    return out.select(F.col("drug").alias("source"), F.concat_ws("_", "k.effect", "process").alias("edge_type"), F.col("protein").alias("target"), F.array_join(F.array_sort("k.refs"), ",").alias("references"))


def complex_members(rows: DataFrame) -> DataFrame:
    """source, edge_type, target, references of the proteins among the participants of complexes (complex, participants,
    refs); ``-`` stands for none, and gives null references."""
    part = rows.select("complex", "refs", F.explode(F.split("participants", r"\|")).alias("p")).where(F.col("p").startswith("uniprot:"))
    refs = F.when(F.col("refs") != "-", F.replace("refs", F.lit("|"), F.lit(",")))
    return part.select(F.split_part("p", F.lit(":"), F.lit(2)).alias("source"), F.lit("PROTEIN_MEMBER_OF").alias("edge_type"), F.col("complex").alias("target"), refs.alias("references")).distinct()


def category_triples(lines: DataFrame) -> DataFrame:
    """source, edge_type, target of piped lines (column ``value``): field 2 is the number, field 10 its category."""
    part = F.split("value", r"\|")
    hit = lines.where(~F.col("value").startswith("#") & (F.size(part) > 9))
    return hit.select(F.concat(F.lit("MIM:"), F.get(part, 1)).alias("source"), F.lit("CATEGORY").alias("edge_type"), effect_key(F.get(part, 9)).alias("target")).distinct()
