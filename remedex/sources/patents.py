"""Landed patent pages as records: marked fields, sections by their headings, claims with the claims they depend on.

A page is read once, tag by tag: a stack of open elements says where each element's text begins and ends, so elements of one name may lie
within each other, and all character references are decoded.  What is found is then put into shape by column functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedex.functions.once import once

# The headings of sections.
SECTIONS = {
    "background": r"(?i)(?:BACKGROUND(?:\s+OF\s+THE\s+INVENTION)?|FIELD\s+OF\s+THE\s+INVENTION)",
    "summary": r"(?i)(?:BRIEF\s+SUMMARY|SUMMARY(?:\s+OF\s+THE\s+INVENTION)?)",
    "description": r"(?i)(?:DETAILED\s+DESCRIPTION|DESCRIPTION\s+OF\s+THE\s+(?:PREFERRED\s+)?EMBODIMENTS?)",
}
MOST = 20_000  # code points of a section, where pages are read for a preview
CLAIM_WORDS = ("claims", "what is claimed", "the invention claimed")
CLAIM = "array<struct<number: int, text: string>>"
PAGE = f"title string, abstract string, assignee string, inventors array<string>, filing_date string, publication_date string, _text string, _found {CLAIM}"
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
SILENT = frozenset(("script", "style", "template"))


class Elements(HTMLParser):
    """Texts of a page in order, and its elements: name, attributes, and which texts lie within."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.found: list[list] = []  # name, attributes, first text, text after the last
        self.open: list[int] = []
        self.run: list[str] = []
        self.feed(html)
        self.close()
        self._end()
        while self.open:
            self.found[self.open.pop()][3] = len(self.texts)

    def _end(self) -> None:
        text = " ".join("".join(self.run).split())
        if text and not any(self.found[i][0] in SILENT for i in self.open):
            self.texts.append(text)
        self.run.clear()

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_comment(self, data: str) -> None:
        self._end()

    def handle_starttag(self, tag: str, attrs) -> None:
        self._end()
        self.found.append([tag, {k: v or "" for k, v in reversed(attrs)}, len(self.texts), len(self.texts)])
        if tag not in VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self._end()
        self.found.append([tag, dict(attrs), len(self.texts), len(self.texts)])

    def handle_endtag(self, tag: str) -> None:
        self._end()
        if any(self.found[i][0] == tag for i in self.open):
            while self.open:
                i = self.open.pop()
                self.found[i][3] = len(self.texts)
                if self.found[i][0] == tag:
                    break

    def all(self, tag: str, key: str, value: str) -> list[list]:
        """Elements of a name with an attribute; a class may be one of several."""
        return [e for e in self.found if e[0] == tag and key in e[1] and (e[1][key] == value or key == "class" and value in e[1][key].split())]

    def text(self, e: list, between: str = " ") -> str:
        return between.join(self.texts[e[2] : e[3]])


def _first(page: Elements, *wanted: tuple[str, str, str]) -> list | None:
    return next((found[0] for w in wanted if (found := page.all(*w))), None)


def _day(page: Elements, name: str) -> str | None:
    e = _first(page, ("time", "itemprop", name))
    return None if e is None else e[1].get("datetime") or page.text(e) or None


def _number(page: Elements, e: list) -> int | None:
    digits = "".join(c if c.isdecimal() else " " for c in e[1].get("num", "")).split()
    if e[1].get("num"):
        return int(digits[0]) if digits else None
    head, mark, _ = page.text(e).replace(")", ".", 1).partition(".")
    return int(head) if mark and head.isdecimal() else None


def page_fields(html: str | None) -> dict:
    """The fields of ``PAGE`` of one page."""
    page = Elements(html or "")
    shown = lambda e: None if e is None else page.text(e) or None
    title = _first(page, ("span", "itemprop", "title"))
    named = _first(page, ("meta", "name", "DC.title")) if title is None else None
    area = _first(page, ("section", "itemprop", "claims"), ("div", "class", "claims"), ("section", "class", "claims"))
    blocks = [] if area is None else [e for e in page.found[page.found.index(area) + 1 :] if e[0] == "div" and "claim" in e[1].get("class", "") and area[2] <= e[2] and e[3] <= area[3]]
    return {
        "title": shown(title) if named is None else named[1].get("content") or None,
        "abstract": shown(_first(page, ("section", "itemprop", "abstract"), ("div", "class", "abstract"))),
        "assignee": shown(_first(page, ("dd", "itemprop", "assigneeCurrentOriginal"), ("dd", "itemprop", "assigneeOriginal"))),
        "inventors": [page.text(e) for e in page.all("dd", "itemprop", "inventor")],
        "filing_date": _day(page, "filingDate"),
        "publication_date": _day(page, "publicationDate"),
        "_text": "\n".join(page.texts),
        "_found": [{"number": _number(page, e), "text": page.text(e)} for e in blocks],
    }


def _fields(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split(" ")[0] for x in PAGE.replace(CLAIM, "claims").split(", ")]
    for b in pages:
        yield pd.DataFrame([page_fields(x) for x in b], columns=names)


def sections(text: Column, most: int | None = None) -> Column:
    """Text by section name: each goes from its first heading to the next heading found, whole unless ``most`` bounds it."""
    found = [F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.length(F.regexp_substr(text, F.lit(p))).alias("n"), F.lit(k).alias("name")) for k, p in SECTIONS.items()]
    heads = F.array_sort(F.filter(F.array(*found), lambda h: h["at"] > 0))

    def body(hs: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(hs, i + 1)["at"], F.length(text) + 1)
            begin = h["at"] + h["n"]
            cut = F.regexp_replace(F.substring(text, begin, F.greatest(stop - begin, F.lit(0))), r"^[ :.—-]+|[ :.—-]+$", "")
            whole = F.regexp_replace(cut, r"^\s+|\s+$", "")
            return F.struct(h["name"].alias("key"), (whole if most is None else F.substring(whole, 1, most)).alias("value"))

        return F.transform(hs, one)

    return F.map_from_entries(F.flatten(F.transform(F.array(heads), body)))


def depends_on(text: Column) -> Column:
    """The claims that a claim names, in order."""
    span = r"(?i)claims?\s+(\d+)\s*(?:-|to|or|and)\s*(\d+)"
    every = [F.regexp_extract_all(text, F.lit(p), g) for p, g in ((span, 1), (span, 2), (r"(?i)claims?\s+(\d+)", 1))]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*every), lambda x: x.cast("int"))))


def _listed(text: Column) -> Column:
    """Claims of plain text, after the first word that announces them."""
    at = once(F.lower(text), lambda low: F.coalesce(*[F.nullif(F.instr(low, w), F.lit(0)) for w in CLAIM_WORDS]))
    block = F.coalesce(F.substring(text, at, F.length(text)), F.lit(""))
    pattern = F.lit(r"(?s)(?:^|\n)\s*(\d+)\.\s+(.*?)(?=\n\s*\d+\.\s|$)")
    both = once(block, lambda b: F.arrays_zip(F.regexp_extract_all(b, pattern, 1).alias("n"), F.regexp_extract_all(b, pattern, 2).alias("t")))
    clean = lambda t: F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^ | $", "")
    return F.transform(both, lambda x: F.struct(x["n"].try_cast("int").alias("number"), clean(x["t"]).alias("text")))


def _claims(found: Column) -> Column:
    """number, text, dependent, depends_on by number: the first of each number, without its number, if a text is left."""
    firsts = lambda all_, n: F.filter(all_, lambda c, i: c["number"].isNotNull() & (F.array_position(n, c["number"]) == i + 1))
    first = once(found, lambda all_: once(all_["number"], lambda n: firsts(all_, n)))
    cut = F.transform(first, lambda c: F.struct(c["number"].alias("number"), F.regexp_replace(c["text"], r"^\s*\d+[.)]\s*", "").alias("text")))
    full = F.array_sort(F.filter(cut, lambda c: c["text"] != ""))
    return F.transform(full, lambda c: once(depends_on(c["text"]), lambda d: F.struct(c["number"].alias("number"), c["text"].alias("text"), (F.size(d) > 0).alias("dependent"), d.alias("depends_on"))))


def page_records(pages: DataFrame, html: str = "html", most: int | None = MOST) -> DataFrame:
    """title, abstract, assignee, inventors, filing_date, publication_date, sections, claims of every page; other columns stay.

    Fields that a page lacks are null, lists and maps are empty then; a null page is an empty one. ``most`` bounds the code points of a
    section; with None sections are whole.
    """
    out = pages.withColumn("_f", F.pandas_udf(_fields, PAGE)(F.col(html).cast("string")))
    own = ["title", "abstract", "assignee", "inventors", "filing_date", "publication_date", "_text", "_found"]
    out = out.withColumns({k: F.col("_f")[k] for k in own}).withColumn("abstract", F.regexp_replace("abstract", r"(?i)^Abstract\s*", ""))
    # The explode of one element keeps sections and claims from being copied into all that reads them.
    claims = once(_claims(F.col("_found")), lambda c: F.when(F.size(c) > 0, c).otherwise(_claims(_listed(F.col("_text")))))
    out = out.select("*", F.inline(F.array(F.struct(sections(F.col("_text"), most).alias("sections"), claims.alias("claims")))))
    return out.drop("_f", "_text", "_found", html)
