"""Column functions over prose and queries: tokens, sentences, relation phrases, citations, similarity, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, weights and markers that results must agree with.
RELATIONS = (
    "regulates", "regulated by", "upregulates", "downregulates", "activates", "activation of", "inhibits",
    "inhibition of", "suppresses", "induces", "modulates", "mediates", "phosphorylates", "targets", "increases",
    "decreases", "reduces", "improves", "impairs", "attenuates", "ameliorates", "protects against", "contributes to",
    "causes", "leads to", "results in", "associated with", "correlated with", "linked to", "implicated in",
    "involved in", "plays a role in", "plays a key role in", "is a biomarker for", "predisposes to",
)
SECTION_WEIGHTS = {"title": 1.0, "abstract": 1.0, "results": 0.6, "discussion": 0.6, "conclusion": 0.6, "methods": 0.3, "introduction": 0.3, "intro": 0.3, "references": 0.3}
OTHER_SECTION = 0.3
WINDOW = 120
CITATIONS = (
    r"\[\s*\d+(\s*[,\-–]\s*\d+)*\s*\]",
    r"\(\s*\d+(\s*[,\-–]\s*\d+)*\s*\)",
    r"\bet\s+al\.?",
    r"\(\s*[A-Z][A-Za-z\-']+[^)]{0,40}?\b(19|20)\d{2}[a-z]?\s*\)",
    r"(?i:\bref(?:s|erence)?\.?\s*\d+)",
)
QUESTION_STARTS = ("what", "how", "why", "when", "where", "which", "who", "is", "are", "can", "does", "do")


def longest_first(phrases) -> str:
    """One alternation in which longer phrases come before shorter ones; spaces match any white space."""
    return r"(?iU)\b(" + "|".join(p.replace(" ", r"\s+") for p in sorted(phrases, key=lambda p: (-len(p), p))) + r")\b"


def relation_phrase(sentence: Column, phrases=RELATIONS) -> Column:
    """The longest phrase that occurs; null if none does. Length decides before place."""
    return F.coalesce(*[F.when(sentence.rlike(longest_first([p])), F.lit(p)) for p in sorted(phrases, key=len, reverse=True)])


def phrase_place(sentence: Column, phrase: Column) -> Column:
    """The first place of a phrase, counted from 1; 0 if it does not occur."""
    return F.regexp_instr(sentence, F.concat(F.lit(r"(?iU)\b"), F.regexp_replace(phrase, " ", r"\\s+"), F.lit(r"\b")))


def is_cited(sentence: Column, place: Column, size: Column, window: int = WINDOW) -> Column:
    """Whether a citation marker stands within the window around a phrase (or anywhere if there is no phrase)."""
    start = F.greatest(place - window, F.lit(1))
    around = F.when(F.coalesce(place, F.lit(0)) > 0, F.substring(sentence, start, place + size + window - start)).otherwise(sentence)
    return around.rlike("|".join(f"(?:{c})" for c in CITATIONS))


def section_weight(section: Column, weights: dict = SECTION_WEIGHTS, other: float = OTHER_SECTION) -> Column:
    """The weight of a section by its exact name, else of the first name that its heading holds."""
    key = F.lower(F.trim(F.coalesce(section, F.lit(""))))
    exact = [F.when(key == k, F.lit(v)) for k, v in weights.items()]
    inside = [F.when(key.contains(k), F.lit(v)) for k, v in weights.items()]
    return F.coalesce(*exact, *inside, F.lit(other))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ? where a capital, a bracket or a parenthesis follows."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z(\[])"), lambda x: F.trim(x)), lambda s: s != "")


def terms_in(text: Column, terms) -> Column:
    """Those of the terms that occur, ignoring case, in their order and once."""
    low = F.lower(text)
    return F.array_distinct(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t))))


def plain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def hyphen_tokens(text: Column) -> Column:
    """Words of letters and digits; a hyphenated one counts as a whole and by its parts."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[A-Za-z0-9][A-Za-z0-9\\-]*"), 0)
    parts = F.transform(found, lambda w: F.when(F.contains(w, F.lit("-")), F.concat(F.array(w), F.filter(F.split(w, "-"), lambda p: p != ""))).otherwise(F.array(w)))
    return F.flatten(parts)


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two token sets; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if one is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def looks_like_title(query: Column) -> Column:
    """Quoted, or of four words or more that do not ask and hold a hyphen or a capitalised word."""
    q = F.trim(F.coalesce(query, F.lit("")))
    words = F.split(q, r"\s+")
    quoted = (q.startswith('"') & q.endswith('"')) | (q.startswith("'") & q.endswith("'"))
    asks = F.lower(F.get(words, 0)).isin(*QUESTION_STARTS)
    shaped = q.contains("-") | F.exists(words, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}"))
    return (q != "") & (quoted | ((F.size(words) >= 4) & ~asks & shaped))


def patent_id(raw: Column) -> Column:
    """The stored form of a publication number: no URL, language suffix, query string or punctuation, upper case."""
    out = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?i)^/?patent/", "")
    out = F.upper(F.regexp_replace(out, r"(?i)^https?://patents\.google\.com/patent/", ""))
    for pattern in (r"/[A-Z]{2}$", r"[?#].*$", r"[\s.,\-]+"):
        out = F.regexp_replace(out, pattern, "")
    return out


def canonical_patent_id(id_: Column) -> Column:
    """US pre-grant numbers with a serial of six digits get the seventh, a leading zero of the serial."""
    p = r"^US(\d{4})(\d{6})(A\d)$"
    return F.when(id_.rlike(p), F.concat(F.lit("US"), F.regexp_extract(id_, p, 1), F.lpad(F.regexp_extract(id_, p, 2), 7, "0"), F.regexp_extract(id_, p, 3))).otherwise(id_)


def claims_named(text: Column) -> Column:
    """Numbers of the claims that a text refers to, sorted; of a range only its two ends."""
    pair = r"(?i)claims?\s+(\d+)\s*(?:-|to|or|and)\s*(\d+)"
    one = r"(?i)claims?\s+(\d+)"
    found = F.concat(F.regexp_extract_all(text, F.lit(pair), 1), F.regexp_extract_all(text, F.lit(pair), 2), F.regexp_extract_all(text, F.lit(one), 1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def gene_symbol(query: Column, stop=("THE", "AND", "FOR", "DNA", "RNA", "KG", "FDA")) -> Column:
    """The first all-caps token that is no stop word, else the first token that ends with a digit, else empty."""
    caps = F.filter(F.regexp_extract_all(query, F.lit(r"\b[A-Z][A-Z0-9]{1,9}\b"), 0), lambda t: ~t.isin(*stop))
    digit = F.regexp_extract_all(query, F.lit(r"\b[A-Za-z][A-Za-z0-9]*\d\b"), 0)
    return F.coalesce(F.get(caps, 0), F.upper(F.get(digit, 0)), F.lit(""))


def accession(text: Column) -> Column:
    """The first protein accession of a text; null if there is none."""
    got = F.regexp_extract(text, r"\b([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})\b", 1)
    return F.when(got != "", got)


def routed(query: Column, mentions: dict, keywords: dict, default: str) -> Column:
    """A module by its @mention, else by the first group with a keyword in the text, else the default."""
    at = F.lower(F.regexp_extract(query, r"@(\w+)", 1))
    low = F.lower(query)
    by_mention = [F.when(at == k, F.lit(v)) for k, v in mentions.items()]
    by_word = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(k)) for k, words in keywords.items()]
    return F.coalesce(*by_mention, *by_word, F.lit(default))


def without_noise(query: Column, phrases) -> Column:
    """A query without its @mention, the first occurrence of each stop phrase, and punctuation at its ends."""
    out = F.regexp_replace(query, r"@\w+", "")
    for p in phrases:
        at = F.regexp_instr(out, F.lit(rf"(?i)\b{p}\b"))
        out = F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), F.substring(out, at + len(p), F.length(out)))).otherwise(out)
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"^[\s.,;:!?]+|[\s.,;:!?]+$", "")


def target_and_disease(query: Column) -> Column:
    """(target, disease) of a query, cut once at the first separator that is present; one side only is the target."""
    out = F.struct(F.trim(query).alias("target"), F.lit("").alias("disease"))
    for sep in reversed((" in ", " for ", " against ", " — ", " - ", ",")):
        at = F.instr(query, sep)
        left, right = F.trim(F.substring(query, F.lit(1), at - 1)), F.trim(F.substring(query, at + len(sep), F.length(query)))
        both = F.struct(F.when(left == "", right).otherwise(left).alias("target"), F.when(left == "", F.lit("")).otherwise(right).alias("disease"))
        out = F.when(at > 0, both).otherwise(out)
    return out


def numbered_reply(text: Column, expected: int) -> Column:
    """Number to text of the lines ``n. text`` with 1 <= n <= expected; the last of equal numbers stays."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d{1,6}[.)]\s+\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)", 1).cast("int").alias("k"), F.trim(F.regexp_extract(x, r"^\s*\d+[.)]\s+(.*)$", 1)).alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"].between(1, expected))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def trimmed_to_sentence(text: Column) -> Column:
    """A text cut at its last sentence end, if it stops in mid-sentence and the cut keeps half of it or more."""
    t = F.trim(text)
    cut = F.regexp_extract(t, r"(?s)^(.*[.!?])", 1)
    return F.when(~t.rlike(r"[.!?:]$") & (F.length(cut) * 2 >= F.length(t)) & (cut != ""), cut).otherwise(t)
