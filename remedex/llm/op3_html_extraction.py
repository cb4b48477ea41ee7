"""HTML extraction by tag-path ratios.

The text of a page comes in blocks, each with the path of its block elements from the root; whether a block is link text
throughout, and whether a class, id or role marks it as other matter, belong to its path.  Each path has the mean text
length and the mean punctuation count of its blocks.  Both ratios are smoothed over the blocks in page order and fused to
one score, which counts little for link paths and marked paths.  A heading has the score of the text that it heads.

The scores choose the region: the article with the largest sum and those that hold a fair share of its scored text (else ``main``, else the
smallest element that holds most of the page's sum).  Within it, paths whose score reaches a share of the region's mean are content, whatever their
blocks' lengths; a heading goes with the text that it heads.  Elements that never hold main text (menus, forms, scripts, footers ...), headers outside an article and
articles within an article (reader comments) hold no blocks.

Pages are independent: one map over batches, no shuffle; a page costs time and memory in proportion to its length, and
paths and elements are numbered, so deep nesting costs nothing more.  Defined cases: null, empty or text-free html gives
an empty text and 0 characters; a tag cut off at the end is markup; of two articles with equal sums the first is taken;
repeated rows give repeated rows; null ids and urls stay; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from remedex.llm.common import small_batches, table

NAME = "op3_html_extraction"

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|iframe|noembed|noframes|textarea|title|xmp"
NEVER = frozenset("head nav footer aside form dialog menu fieldset object canvas audio video noscript template svg select button datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DIVISION = frozenset("html body main section div center table tbody tr td".split())
#: Opening one of these closes an open element of the same set, up to the nearest listed boundary.
CLOSES = {"p": ({"p"}, BLOCK - {"p"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Whole names of classes, ids and roles that mark other matter than main text, and parts that may follow them.
OTHER = re.compile(
    r"(?:ad|ads|advert|advertisement|adverts|banner|breadcrumb|breadcrumbs|comment|comments|cookie|cookies|consent|disqus|footer|login|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|pagination|popup|promo|promoted|promotion|related|replies|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|toolbar|widget)"
    r"(?:[_-](?:ad|ads|area|banner|bar|block|box|buttons|container|content|form|icons|inner|item|links|list|menu|notice|panel|posts|section|slot|text|thread|unit|widget|wrap|wrapper))*",
    re.I,
)
RULE, MOST = 0.02, 0.75  # share of the region's mean that a path must reach; share of the sum that the smallest element must hold
LINKS, MARKED, PEER = 0.01, 0.01, 0.2  # what link text, and marked elements, count for; share of the best article's text, weighted by score, that another one must reach
KERNEL = np.array([0.25, 0.5, 0.25])

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


@dataclass
class Element:
    """An open element, with what holds for the text in it."""

    tag: str = ""
    path: int = 0  # number of the path of block elements
    own: int = 0  # number of the block element itself
    allowed: bool = True
    marked: bool = False
    link: bool = False
    article: int = -1  # number of the article, or of the main, that it lies in
    main: int = -1


@dataclass
class Block:
    at: Element
    heading: bool
    parts: list[str] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    text: str = ""


def _is_other(attributes: str) -> bool:
    names = " ".join(next(filter(None, x), "") for x in _ATTR.findall(attributes)).split()
    return any(OTHER.fullmatch(n) for n in names)


def blocks(page: str) -> tuple[list[Block], list[int], list[str]]:
    """The blocks with text in page order; the parent and the tag of every block element (0 is the page)."""
    out: list[Block] = []
    paths: dict[tuple[int, str, bool], int] = {}
    parent, tags = [0], [""]
    stack, opened = [Element()], {}
    now: Block | None = None
    at = 0

    def close(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    def text(end: int) -> None:
        nonlocal now
        e = stack[-1]
        if end <= at or not e.allowed:
            return
        raw = page[at:end]
        if now is None:
            if raw.isspace():
                return
            now = Block(e, tags[e.own] in HEADING)
            out.append(now)
        raw = html_lib.unescape(raw)
        now.parts.append(raw)
        n = len(raw.strip())
        now.chars += n
        now.link_chars += n if e.link else 0

    for m in _TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            now = None
        elif tag == "br" and now is not None:
            now.parts.append(" ")
        if m[2]:
            if opened.get(tag):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if tag in VOID or m[4].endswith("/") and tag not in BLOCK:
            continue
        if (rule := CLOSES.get(tag)) and any(opened.get(t) for t in rule[0]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in rule[0]:
                    close(i)
                    break
                if stack[i].tag in rule[1]:
                    break
        up = stack[-1]
        marked = up.marked or tag not in ("html", "body") and bool(m[4]) and _is_other(m[4])
        never = tag in NEVER or tag == "header" and up.article < 0 and up.main < 0 or tag == "article" and up.article >= 0
        e = Element(tag, up.path, up.own, up.allowed and not never, marked, up.link or tag == "a", up.article, up.main)
        if tag in BLOCK:
            e.path = paths.setdefault((up.path, tag, marked), len(paths) + 1)
            e.own = len(tags)
            parent.append(up.own)
            tags.append(tag)
            if tag == "article" and up.article < 0:
                e.article = e.own
            if tag == "main" and up.main < 0:
                e.main = e.own
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(e)
    text(len(page))
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text], parent, tags


def scores(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the path of each block, and the fused score of its path."""
    kinds: dict[tuple[int, bool, bool], int] = {}
    linked = [not b.heading and b.link_chars >= 0.9 * b.chars for b in found]
    path = np.array([kinds.setdefault((b.at.path, b.at.marked, k), len(kinds)) for b, k in zip(found, linked, strict=True)])
    count = np.bincount(path, minlength=len(kinds))
    size = np.array([len(b.text) for b in found], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in found], dtype=float)
    ratio = lambda x: np.convolve(np.pad((np.bincount(path, x, len(kinds)) / count)[path], 1, "edge"), KERNEL, "valid")
    fused = np.log1p(ratio(size)) * (1 + np.log1p(ratio(marks)))
    fused *= np.where(linked, LINKS, 1.0) * np.where([b.at.marked for b in found], MARKED, 1.0)
    below = 0.0
    for i in range(len(found) - 1, -1, -1):  # a heading has the score of what it heads, if that is more
        if found[i].heading and not found[i].at.marked:
            fused[i] = max(fused[i], below)
        below = fused[i]
    return path, (np.bincount(path, fused, len(kinds)) / count)[path]


def region(found: list[Block], score: np.ndarray, parent: list[int], tags: list[str]) -> np.ndarray:
    """Which blocks lie in the region of the main text: the best article, or main, and those like it."""
    size = np.array([len(b.text) for b in found], dtype=float)
    for of in ([b.at.article for b in found], [b.at.main for b in found]):
        which = np.array(of)
        if (which >= 0).any():
            held = which[which >= 0]
            sums, mass = np.bincount(held, score[which >= 0]), np.bincount(held, (score * size)[which >= 0])
            return np.isin(which, np.flatnonzero((mass >= PEER * mass[sums.argmax()]) & (mass > 0)))
    own = np.array([b.at.own for b in found])
    sums = np.bincount(own, score, len(parent))
    for i in range(len(parent) - 1, 0, -1):  # children come after their parents
        sums[parent[i]] += sums[i]
    best = 0
    for i in range(1, len(parent)):  # in page order, so each is met after the element it lies in
        if parent[i] == best and tags[i] in DIVISION and sums[i] >= MOST * sums[best]:
            best = i
    inside = np.zeros(len(parent), dtype=bool)
    inside[best] = True
    for i in range(best + 1, len(parent)):
        inside[i] = inside[parent[i]]
    return inside[own]


def extract(page: str | None, rule: float = RULE) -> str:
    """The main text: blocks joined by newlines."""
    found, parent, tags = blocks(page) if page else ([], [], [])
    if not found:
        return ""
    path, score = scores(found)
    inside = region(found, score, parent, tags)
    size = np.array([len(b.text) for b in found], dtype=float) * inside
    least = rule * float((score * size).sum() / size.sum())
    kept = inside & np.isin(path, np.unique(path[inside & (score >= least)]))
    return "\n".join(found[i].text for i in np.flatnonzero(headed(found, tags, inside, kept)))


def headed(found: list[Block], tags: list[str], inside: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """What is kept, without headings of whose text, up to the next heading of their rank, nothing is."""
    out = kept.copy()
    some, any_ = [False] * 8, [False] * 8  # whether text, and kept text, was met since the last heading of each rank, from the end
    for i in range(len(found) - 1, -1, -1):
        if not inside[i]:
            continue
        if found[i].heading:
            rank = int(tags[found[i].at.own][1])
            if some[rank] and not any_[rank]:
                out[i] = False
            for r in range(rank, 8):
                some[r] = any_[r] = False
        else:
            some = [True] * 8
            any_ = [x or bool(kept[i]) for x in any_]
    return out


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 200):
                part = b.iloc[lo : lo + 200]
                text = [extract(x) for x in part["_html"]]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": pd.Series(text, dtype=object, index=part.index), "n_chars": np.array([len(x) for x in text], dtype=np.int64)})

    small_batches(pages.sparkSession)
    # Ids pass as text, as pandas has no whole numbers beside nulls.
    ids = pages.select(pages["page_id"].cast("string").alias("page_id"), pages["url"].cast("string").alias("url"), pages[html].cast("string").alias("_html"))
    out = ids.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumns({k: out[k].cast(pages.schema[k].dataType) for k in ("page_id", "url")}).select("page_id", "url", "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
