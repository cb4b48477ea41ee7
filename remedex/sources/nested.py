"""Nested XML entries of drugs and of protein expression as statements: one typed scan, arrays of statements at all levels, one explode.

Every statement says which table it belongs to, so ``write_by`` makes all tables of a file from one reading of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.functions.once import once
from remedex.operators.compile import code_levels, interaction_effects

_POLY = "polypeptide: struct<_source: string, _id: string, `external-identifiers`: struct<`external-identifier`: array<struct<resource: string, identifier: string>>>>"
_LINK = f"array<struct<references: struct<articles: struct<article: array<struct<`pubmed-id`: string>>>>, actions: struct<action: array<string>>, {_POLY}>>"
#: The parts of a drug's entry that are read.
DRUG = f"""`drugbank-id` array<struct<_VALUE: string, _primary: boolean>>, name string, `mechanism-of-action` string,
groups struct<`group`: array<string>>, synonyms struct<synonym: array<struct<_VALUE: string, _language: string>>>,
`general-references` struct<articles: struct<article: array<struct<`pubmed-id`: string>>>>, products struct<product: array<struct<name: string>>>,
classification struct<kingdom: string, superclass: string, class: string, subclass: string, `direct-parent`: string>,
targets struct<target: {_LINK}>, carriers struct<carrier: {_LINK}>, transporters struct<transporter: {_LINK}>, enzymes struct<enzyme: {_LINK}>,
`drug-interactions` struct<`drug-interaction`: array<struct<`drugbank-id`: string, name: string, description: string>>>,
`atc-codes` struct<`atc-code`: array<struct<_code: string>>>, categories struct<category: array<struct<`mesh-id`: string>>>,
pathways struct<pathway: array<struct<`smpdb-id`: string, name: string, category: string, enzymes: struct<`uniprot-id`: array<string>>>>>"""
#: The parts of an expression entry that are read.
EXPRESSION = """identifier struct<xref: array<struct<_id: string, _db: string>>>, antibody array<struct<_id: string, antigenSequence: string>>,
tissueExpression array<struct<data: array<struct<cellLine: string, tissue: string, level: string, tissueCell: array<struct<cellType: string, level: string>>>>>>,
rnaExpression array<struct<data: array<struct<cellLine: struct<_VALUE: string, _cellosaurusID: string, _organ: string>, tissue: string,
  level: array<struct<_VALUE: string, _expRNA: string>>, tissueCell: array<struct<cellType: string, level: string>>>>>>"""
STATEMENT = "array<struct<kind: string, source: string, edge_type: string, target: string, qualifier: string, references: string>>"


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    """Top entries of drug files; the drugs that pathways name have no primary id and are left out."""
    entries = spark.read.format("xml").option("rowTag", "drug").option("ignoreNamespace", "true").schema(DRUG).load(path)
    return entries.where(F.exists("`drugbank-id`", lambda x: x["_primary"]))


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(EXPRESSION).load(path)


def key_text(text: Column) -> Column:
    """Text with all but letters and digits as ``_``; null if it is blank."""
    return F.nullif(F.regexp_replace(F.trim(text), "[^a-zA-Z0-9]", "_"), F.lit(""))


def _statements(kind: str, source: Column, edge: str | Column, items: Column, target, qualifier=None, references=None) -> Column:
    """A statement for each item; items without a target are left out."""
    text = lambda f, x: F.lit(None).cast("string") if f is None else f(x)
    edge = F.lit(edge) if isinstance(edge, str) else edge
    made = F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), source.alias("source"), edge.alias("edge_type"), target(x).alias("target"), text(qualifier, x).alias("qualifier"), text(references, x).alias("references")))
    return F.filter(F.coalesce(made, F.array().cast(STATEMENT)), lambda s: s["target"].isNotNull() & s["source"].isNotNull())


def _every(lists: Column) -> Column:
    return F.flatten(F.filter(F.coalesce(lists, F.array().cast(f"array<{STATEMENT}>")), lambda x: x.isNotNull()))


def _protein(link: Column) -> Column:
    """The protein of a target: its own id if it is a reviewed one, else the first external one."""
    poly = link["polypeptide"]
    others = F.filter(poly["external-identifiers"]["external-identifier"], lambda x: x["resource"] == "UniprotKB")
    return F.when(poly["_source"] == "Swiss-Prot", poly["_id"]).otherwise(key_text(F.get(others, 0)["identifier"]))


def _targets(drug: Column, edge: str, links: Column) -> Column:
    """A statement for each action of each target, with its publications."""

    def one(link: Column) -> Column:
        named = F.transform(link["actions"]["action"], key_text)
        named = F.transform(F.filter(named, lambda a: a.isNotNull()), lambda a: F.when(a.isin("other", "other_unknown"), "unknown").otherwise(a))
        actions = once(named, lambda n: F.when(F.size(F.coalesce(n, F.array().cast("array<string>"))) > 0, n).otherwise(F.array(F.lit("unknown"))))
        papers = F.filter(F.transform(link["references"]["articles"]["article"], lambda x: key_text(x["pubmed-id"])), lambda x: x.isNotNull())
        refs = F.nullif(F.array_join(papers, ","), F.lit(""))
        facts = F.struct(_protein(link).alias("protein"), refs.alias("refs"))
        return once(facts, lambda f: _statements("target", drug, edge, actions, lambda a: f["protein"], lambda a: a, lambda a: f["refs"]))

    return _every(F.transform(links, one))


def _pathways(drug: Column, pathways: Column) -> Column:
    """A drug's pathways, their categories, and their enzymes."""

    def one(p: Column) -> Column:
        name, known = p["smpdb-id"], F.when(p["smpdb-id"].isNotNull(), F.array(p))
        return F.concat(
            _statements("pathway", drug, "DRUG_PATHWAY", known, lambda x: name),
            _statements("pathway", name, "PATHWAY_CATEGORY", known, lambda x: F.nullif(F.trim(x["category"]), F.lit(""))),
            _statements("pathway", name, "PATHWAY_ENZYME", p["enzymes"]["uniprot-id"], key_text),
        )

    return _every(F.transform(pathways, one))


def drug_statements(entries: DataFrame) -> DataFrame:
    """kind (of table), source, edge_type, target, qualifier, references of drug entries; each once for an entry."""
    c = F.col
    primary = F.get(F.filter("`drugbank-id`", lambda x: x["_primary"]), 0)["_VALUE"]
    entries = entries.select("*", F.inline(F.array(F.struct(primary.alias("_drug")))))  # not copied into each statement
    drug = c("_drug")
    one = lambda x: F.array(x)
    whole = c("classification")
    ranks = [_statements("classification", drug, F.upper(F.lit(k.replace("-", "_"))), one(whole[k]), key_text) for k in ("kingdom", "superclass", "class", "subclass", "direct-parent")]
    met = c("`drug-interactions`")["drug-interaction"]
    said = lambda x: F.nullif(F.trim(F.regexp_replace(x["description"], "[\t\n]", " ")), F.lit(""))
    parts = [
        _statements("meta", drug, "TYPE", one(F.lit("DRUG")), lambda x: x),
        _statements("meta", drug, "NAME", one(c("name")), key_text),
        _statements("meta", drug, "SYNONYM", F.filter(c("synonyms.synonym"), lambda x: x["_language"] == "english"), lambda x: key_text(x["_VALUE"])),
        _statements("stage", drug, "PRODUCT_STAGE", c("groups.`group`"), key_text),
        _statements("meta", drug, "PUBMED_ARTICLE", c("`general-references`.articles.article"), lambda x: key_text(x["pubmed-id"])),
        _statements("meta", drug, "PRODUCT", c("products.product"), lambda x: key_text(x["name"])),
        _statements("mechanism", drug, "MECHANISM", one(c("`mechanism-of-action`")), lambda x: F.nullif(F.trim(F.regexp_replace(x, r"\s", " ")), F.lit(""))),
        *ranks,
        *[_targets(drug, f"DRUG_{k.upper()}", c(f"{k}s.{k}")) for k in ("target", "carrier", "transporter", "enzyme")],
        _every(F.transform(F.filter(met, lambda x: said(x).isNull()), lambda x: _statements("interaction", drug, "DRUG_INTERACTION", one(x), lambda y: key_text(y["drugbank-id"])))),
        _every(F.transform(F.filter(met, lambda x: said(x).isNotNull()), lambda x: once(said(x), lambda s: once(key_text(x["drugbank-id"]), lambda k: _statements("interaction", drug, "DRUG_INTERACTION", interaction_effects(s), lambda e: k, lambda e: e))))),
        _every(F.transform(c("`atc-codes`.`atc-code`"), lambda x: _statements("atc", drug, "DRUG_ATC", code_levels(x["_code"]), lambda k: F.concat(F.lit("ATC:"), k)))),
        _statements("mesh", drug, "MESH_CATEGORY", c("categories.category"), lambda x: F.nullif(x["mesh-id"], F.lit(""))),
        _pathways(drug, c("pathways.pathway")),
    ]
    return entries.select(F.explode(F.array_distinct(F.concat(*parts))).alias("s")).select("s.*")


def _level(kind: str, protein: Column, edge: Column, level: Column) -> Column:
    """One statement of a place and its level, none without a level."""
    return _statements(kind, protein, edge, F.when(level.isNotNull(), F.array(level)), lambda x: x)


def expression_statements(entries: DataFrame) -> DataFrame:
    """kind (tissue, cell_line, antibody), source, edge_type (the place), target (the level) of entries of reviewed proteins.

    Places are tissues, ``tissue__cell`` for their cells, and cell lines, with ``organ#code`` as the qualifier of RNA levels.
    For antibodies the source is the antibody, the target the protein and the qualifier the antigen, ``-`` if it has none.
    """
    first = F.get(F.col("identifier.xref"), 0)
    rows = entries.where(first["_db"] == "Uniprot/SWISSPROT")
    protein, under = first["_id"], lambda x: F.replace(x, F.lit(" "), F.lit("_"))

    def places(d: Column, level: Column) -> list[Column]:
        tissue = under(d["tissue"])
        cells = F.transform(d["tissueCell"], lambda x: _level("tissue", protein, F.concat(tissue, F.lit("__"), under(x["cellType"])), x["level"]))
        return [F.when(tissue.isNotNull(), _level("tissue", protein, tissue, level)).otherwise(F.array().cast(STATEMENT)), F.when(tissue.isNotNull(), _every(cells)).otherwise(F.array().cast(STATEMENT))]

    def stained(d: Column) -> Column:
        line = F.when(d["cellLine"].isNotNull(), _level("cell_line", protein, d["cellLine"], d["level"])).otherwise(F.array().cast(STATEMENT))
        return F.concat(line, *places(d, d["level"]))

    def counted(d: Column) -> Column:
        line, level = d["cellLine"], F.get(d["level"], 0)
        code = F.concat(F.coalesce(line["_organ"], F.lit("")), F.lit("#"), F.coalesce(F.nullif(line["_cellosaurusID"], F.lit("")), F.lit("NA")))
        own = _statements("cell_line", protein, under(line["_VALUE"]), F.when(line["_VALUE"].isNotNull(), F.array(level)), lambda x: F.concat(F.lit("NormRNA_EXP:"), x["_expRNA"]), lambda x: code)
        return F.concat(own, *places(d, level["_VALUE"]))

    data = lambda c: F.flatten(F.transform(c, lambda x: x["data"]))
    antibodies = F.transform("antibody", lambda x: F.struct(F.lit("antibody").alias("kind"), x["_id"].alias("source"), F.lit("ANTIBODY").alias("edge_type"), protein.alias("target"), F.coalesce(x["antigenSequence"], F.lit("-")).alias("qualifier"), F.lit(None).cast("string").alias("references")))
    parts = [_every(F.transform(data("tissueExpression"), stained)), _every(F.transform(data("rnaExpression"), counted)), F.coalesce(antibodies, F.array().cast(STATEMENT))]
    return rows.select(F.explode(reduce(F.concat, parts)).alias("s")).select("s.*")
