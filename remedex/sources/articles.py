"""Article records from XML texts, and their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedex.operators.compile import clamped_date


def _texts(xml: Column, path: str) -> Column:
    """The trimmed texts at a path, without blanks."""
    return F.filter(F.transform(F.xpath(xml, F.lit(f"{path}/text()")), lambda x: F.trim(x)), lambda t: t != "")


def _text(xml: Column, path: str) -> Column:
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(path))), F.lit(""))


def once(words: Column) -> Column:
    """Words once each, ignoring case; the first stays."""
    low = F.transform(words, F.lower)
    return F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def authors_shown(last: Column, initials: Column) -> Column:
    """The first author as ``Name, I.``, and others as et al.; null without authors."""
    first = F.concat(F.get(last, 0), F.coalesce(F.concat(F.lit(", "), F.get(initials, 0), F.lit(".")), F.lit("")))
    return F.when(F.size(last) > 1, F.concat(first, F.lit(" et al."))).otherwise(first)


def parsed(records: DataFrame, xml: str = "xml", keywords: int = 20) -> DataFrame:
    """id, title, abstract, authors, published and keywords of article records, one XML text a row.

    A date without a day or a month is that of the first; texts that are not valid XML fail, as bad input should.
    """
    x = F.col(xml)
    year = F.coalesce(_text(x, "//PubDate/Year"), F.nullif(F.regexp_extract(_text(x, "//PubDate/MedlineDate"), r"(\d{4})", 1), F.lit("")))
    published = clamped_date(year.try_cast("int"), _text(x, "//PubDate/Month"), _text(x, "//PubDate/Day"))
    named = F.slice(once(F.concat(_texts(x, "//Keyword"), _texts(x, "//DescriptorName"))), 1, keywords)
    return records.select(
        _text(x, "//PMID").alias("id"),
        _text(x, "//ArticleTitle").alias("title"),
        F.array_join(_texts(x, "//AbstractText"), " ").alias("abstract"),
        authors_shown(_texts(x, "//Author/LastName"), _texts(x, "//Author/Initials")).alias("authors"),
        published.alias("published"),
        named.alias("keywords"),
    )


def with_sections(abstract: Column, full: Column) -> Column:
    """Sections of the abstract record, with those of the full text in their place where it has them."""
    own = F.coalesce(full, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(abstract, lambda k, v: ~F.map_contains_key(own, k)), own)
