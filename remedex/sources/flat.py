"""Flat files of tagged lines as triples: protein entries and cell line entries.

A record is one row, the text up to its end line, so files are split by records.  Its lines are folded by their tags: what follows a
tag's lines, wherever they stand, is one text, lines without a tag belong to the sequence.  Topics of comments and cross references are
parts of these texts.  All of it is column functions over the record, and one explode gives the rows of all tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.functions.once import once

# The taxa whose proteins are read.
TAXA = ("3702", "224308", "9913", "6239", "9031", "7955", "44689", "7227", "83334", "83333", "9606", "10090", "83331", "83332", "39947", "9601", "10116", "284812", "8355", "559292", "9823")
# Cross references that are read, and the predicates of their ids.
CROSS_REFERENCES = {"HPA": "RELATED_ANTIBODY", "Reactome": "RELATED_PATHWAY", "DrugBank": "TARGET_OF_DRUG", "PROSITE": "PS_SEQ_ANN"}
# Ids within comments.
PROTEIN_CODE, DISORDER_CODE, PUBLICATION = "[OPQ][0-9][A-Z0-9][A-Z0-9][A-Z0-9][0-9]", r"MIM:\d+", r"PubMed=(\d+)"
_FACT = "array<struct<kind: string, edge_type: string, target: string>>"


def read_texts(spark: SparkSession, path: str, end: str = "//\n") -> DataFrame:
    """value: one row for each record of the files."""
    return spark.read.option("lineSep", end).text(path)


def folded(lines: Column, tag: str, width: int = 2) -> Column:
    """The values of a tag's lines in order, each behind a blank; null if the record has no such line."""
    own = F.filter(lines, lambda x: F.substring(x, 1, width) == tag)
    return once(own, lambda o: F.when(F.size(o) > 0, F.array_join(F.transform(o, lambda x: F.concat(F.lit(" "), F.ltrim(F.substring(x, width + 1, 1 << 30)))), "")))


def _lines(value: Column) -> Column:
    return F.transform(F.split(value, "\n"), lambda x: F.rtrim(F.replace(x, F.lit("\r"), F.lit(""))))


def _facts(kind: str, edge: Column | str, targets: Column) -> Column:
    """Statements of one predicate; none without targets."""
    edge = F.lit(edge) if isinstance(edge, str) else edge
    made = F.transform(targets, lambda t: F.struct(F.lit(kind).alias("kind"), edge.alias("edge_type"), t.alias("target")))
    return F.coalesce(made, F.array().cast(_FACT))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def comments(text: Column) -> Column:
    """Topic to text of folded comments; of a topic that stands twice the last one counts."""
    parts = F.filter(F.transform(F.split(F.trim(text), "-!-"), lambda x: F.trim(x)), lambda x: (F.length(x) > 1) & F.contains(x, F.lit(":")))
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))

    def last(all_: Column) -> Column:
        later = lambda keys, i: F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0)))
        return once(all_["key"], lambda keys: F.filter(all_, lambda p, i: ~F.array_contains(later(keys, i), p["key"])))

    return F.map_from_entries(once(pairs, last))


def protein_statements(texts: DataFrame, families: DataFrame | None = None, taxa: Sequence[str] = TAXA) -> DataFrame:
    """kind (facts, metadata, interactions), source, edge_type, target of protein entries (column ``value``).

    ``families`` (family, family_type) gives the predicates of protein family ids; those without one are left out.  The
    second accession of an entry is no OTHER_ID, as in the files that this must agree with.
    """
    tags = lambda lines: F.struct(*[folded(lines, t).alias(t) for t in ("AC", "ID", "DE", "OX", "OC", "RX", "KW", "DR", "CC")])
    # Both explodes deal out an array of one element, so that the optimizer copies neither the tags nor the statements into what reads them.
    rows = texts.select(F.inline(F.array(once(_lines(F.col("value")), tags)))).where("AC IS NOT NULL AND ID IS NOT NULL")
    accessions = F.split(F.trim("AC"), r"\s+")
    names = F.split(F.split_part(F.trim("ID"), F.lit(" "), F.lit(1)), "_")
    taxon = F.split_part(F.regexp_replace(F.split_part(F.trim("OX"), F.lit("="), F.lit(2)), ";$", ""), F.lit(" "), F.lit(1))
    part = lambda key: F.transform(_found(F.col("DE"), f"{key}=([^;]+);", 1), lambda x: F.trim(x))
    links = F.transform(F.split(F.trim("DR"), r"\."), lambda x: F.trim(x))
    of = lambda db: F.filter("links", lambda x: F.split_part(x, F.lit(";"), F.lit(1)) == db)
    code = lambda x: F.trim(F.split_part(x, F.lit(";"), F.lit(2)))
    term = lambda x: F.when(F.contains(x, F.lit("; F:")), "GO_BP").when(F.contains(x, F.lit("; P:")), "GO_MF").otherwise("GO_CC")
    terms = F.transform(of("GO"), lambda x: F.struct(F.lit("facts").alias("kind"), term(x).alias("edge_type"), code(x).alias("target")))
    topics = comments(F.col("CC"))
    topic = lambda k: F.try_element_at("topics", F.lit(k))
    rows = rows.where(taxon.isin(*taxa)).select("*", F.inline(F.array(F.struct(links.alias("links"), topics.alias("topics")))))
    parts = [
        _facts("metadata", "OTHER_ID", F.transform(F.slice(accessions, 3, 1 << 20), lambda x: F.substring(x, 1, F.length(x) - 1))),
        _facts("metadata", "NAME", F.array(F.get(names, 0))),
        _facts("metadata", "SPECIES", F.array(F.element_at(names, -1))),
        _facts("metadata", "FULL_NAME", part("Full")),
        _facts("metadata", "SHORT_NAME", part("Short")),
        _facts("metadata", "ORGANISM_CLASS", F.transform(F.split(F.trim("OC"), ";"), lambda x: F.trim(x))),
        _facts("metadata", "RELATED_PUBMED_ID", F.transform(_found(F.col("RX"), PUBLICATION, 1), lambda x: F.concat(F.lit("pubmed:"), x))),
        _facts("metadata", "RELATED_KEYWORD", F.transform(F.split(F.trim(F.replace("KW", F.lit("."), F.lit(""))), ";"), lambda x: F.trim(x))),
        F.coalesce(terms, F.array().cast(_FACT)),
        *[_facts("facts", edge, F.transform(of(db), code)) for db, edge in CROSS_REFERENCES.items()],
        _facts("family", "", F.transform(of("InterPro"), code)),
        _facts("interactions", "INTERACTS_WITH", _found(topic("INTERACTION"), PROTEIN_CODE)),
        _facts("facts", "RELATED_GENETIC_DISORDER", _found(topic("DISEASE"), DISORDER_CODE)),
    ]
    own = rows.select(F.split_part(F.trim("AC"), F.lit(";"), F.lit(1)).alias("source"), F.explode(F.concat(*parts)).alias("f")).select("f.kind", "source", "f.edge_type", "f.target")
    if families is None:
        return own.where("kind <> 'family'")
    # Other statements look for a text that no family has, so that a join by shuffle deals them by their source.
    family = F.col("kind") == "family"
    kinds = families.select(F.col("family").alias("_key"), F.upper("family_type").alias("_type")).where("_key IS NOT NULL")
    kinds = kinds.withColumn("_key", F.struct(F.lit(True).alias("family"), F.col("_key").alias("of")))
    named = own.withColumn("_key", F.struct(family.alias("family"), F.when(family, F.col("target")).otherwise(F.col("source")).alias("of"))).join(kinds.withColumn("_hit", F.lit(True)), "_key", "left")
    return named.where(~family | F.col("_hit")).select(F.when(family, "facts").otherwise(F.col("kind")).alias("kind"), "source", F.when(family, F.col("_type")).otherwise(F.col("edge_type")).alias("edge_type"), "target")


def family_members(lines: DataFrame) -> DataFrame:
    """source, edge_type, target of a list of protein families: lines (file, line, value) where a heading stands between two
    lines of ``=``; the accessions in brackets below it are its members."""
    from pyspark.sql import Window as W

    bar = F.trim("value").rlike("^=+$")
    by = W.partitionBy("file").orderBy("line")  # a file of this kind is one list of a few hundred lines
    marked = lines.withColumns({"bar": bar, "bars": F.sum(bar.cast("int")).over(by)})
    heading = F.when(~F.col("bar") & (F.col("bars") % 2 == 1), F.trim("value"))
    carried = marked.withColumn("heading", F.last(heading, ignorenulls=True).over(by)).where("NOT bar AND bars > 0 AND bars % 2 = 0")
    words = F.split("heading", r"\s+")
    short = F.when(~F.col("heading").startswith("Atypical"), F.get(words, 0)).when(F.get(words, 1) == "PI3/PI4-kinase", F.lit("AT_PI3/PI4")).otherwise(F.concat(F.lit("AT_"), F.get(words, 1)))
    members = F.transform(_found(F.col("value"), r"\(([A-Za-z0-9 ]*)\)", 1), lambda x: F.trim(x))
    return carried.select(F.explode(members).alias("source"), F.lit("KINASE_FAMILY").alias("edge_type"), short.alias("target")).distinct()


def cell_lines(texts: DataFrame) -> DataFrame:
    """code, names, species, sex, category, disease, datasets, publications of cell line entries (column ``value``).

    Species, datasets and publications gather over all their lines, of the other tags the last line counts. What stands before
    the first entry, lines that begin with a blank or a dash, is left out.
    """
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[A-Z]{2}   "))
    rows = texts.select(lines.alias("x")).where(F.exists("x", lambda x: x.startswith("AC   ")))
    values = lambda t: F.transform(F.filter("x", lambda x: F.substring(x, 1, 2) == t), lambda x: F.substring(x, 6, 1 << 30))
    last = lambda t: F.coalesce(F.try_element_at(values(t), F.lit(-1)), F.lit(""))
    synonyms = F.array_join(F.transform(F.split(last("SY"), ";"), lambda x: F.trim(x)), ",")
    names = F.when(F.length(synonyms) > 1, F.concat(last("ID"), F.lit(","), synonyms)).otherwise(last("ID"))
    species = F.array_join(F.transform(values("OX"), lambda x: F.trim(F.substring_index(x, "!", -1))), ",")
    sex = F.when(F.contains(F.lower(last("SX")), F.lit("unspecified")) | (last("SX") == ""), F.lit("unknown")).otherwise(last("SX"))
    sets = F.transform(F.filter(values("DR"), lambda x: F.contains(x, F.lit("GEO;"))), lambda x: F.substring_index(x, "GEO; ", -1))
    papers = F.flatten(F.transform(values("RX"), lambda x: _found(x, PUBLICATION, 1)))
    return rows.select(
        last("AC").alias("code"),
        F.filter(F.split(F.replace(names, F.lit("#"), F.lit("")), ","), lambda x: x != "").alias("names"),
        F.when(F.size(values("OX")) > 0, species).otherwise(F.lit("unknown")).alias("species"),
        sex.alias("sex"),
        last("CA").alias("category"),
        F.regexp_replace(last("DI"), "^[^;]*;?", "").alias("disease"),
        F.filter(sets, lambda x: x != "").alias("datasets"),
        papers.alias("publications"),
    )


def cell_line_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """The four tables of cell lines: category, map of names, dataset and publication lists; entries without any are left out of these."""
    joined = lambda c: cells.where(F.size(c) > 0).select("code", F.array_join(c, ",").alias(c))
    return {
        "category": cells.select("code", F.array_join("names", ",").alias("names"), "species", "sex", "category", "disease"),
        "map": cells.select(F.explode("names").alias("name"), "code"),
        "datasets": joined("datasets"),
        "publications": joined("publications"),
    }
