"""Column functions on requests: entities of a question by rules, accepted names, keys of cached answers, modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of words that name a disease, in order of preference.
DISEASE_HINTS = (
    "disease", "diseases", "syndrome", "disorder", "cancer", "carcinoma", "tumor", "tumour", "diabetes", "diabetic", "obesity",
    "alzheimer", "parkinson", "sclerosis", "itis", "emia", "opathy", "oma",
)
# Words of a question that name nothing.
QUESTION_STOP = (
    "what", "is", "the", "of", "in", "a", "an", "and", "or", "for", "with", "to", "role", "involvement", "involved", "does", "do",
    "how", "why", "between", "type", "show", "me", "find", "about", "literature", "articles", "papers", "evidence", "on",
)
# Verbs that join a target to a disease.
LINKING_VERBS = (
    "drive", "drives", "cause", "causes", "regulate", "regulates", "activate", "activates", "inhibit", "inhibits", "affect",
    "affects", "influence", "influences", "contribute", "contributes", "promote", "promotes", "modulate", "modulates",
    "mediate", "mediates", "worsen", "worsens", "trigger", "triggers",
)
# Fixed value: the form of a gene's symbol.
GENE_TOKEN = r"^[A-Z][A-Z0-9\-]{1,9}\d?$"


def asked_target(text: Column) -> Column:
    """The first token of a question in the form of a gene's symbol; null if there is none."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9\-]+"), 0)
    return F.get(F.filter(tokens, lambda w: ~F.lower(w).isin(*QUESTION_STOP) & w.rlike(GENE_TOKEN)), 0)


def asked_disease(text: Column) -> Column:
    """The first hint found in a question, with up to two qualifying words before it; null if there is no hint."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    hint = F.coalesce(*[F.when(F.contains(low, F.lit(h)), F.lit(h)) for h in DISEASE_HINTS])
    words = F.reverse(F.regexp_extract_all(F.substring(text, F.lit(1), F.position(hint, low) - 1), F.lit("[A-Za-z0-9]+"), 0))
    part = lambda w: (F.lower(w) == "type") | ~(F.lower(w).isin(*QUESTION_STOP, *LINKING_VERBS) | w.rlike(GENE_TOKEN))
    a, b = F.get(words, 0), F.get(words, 1)
    near = F.when(part(a), F.concat_ws(" ", F.when(part(b), F.lower(b)), F.lower(a)))
    return F.when(hint.isNotNull(), F.concat_ws(" ", near, hint))


def accepted_name(name: Column) -> Column:
    """Whether a pathway's name is shown: not empty and without brackets, which all names of lipid species have."""
    return (F.coalesce(name, F.lit("")) != "") & ~F.coalesce(name, F.lit("")).rlike(r"[(\[]")


def answer_key(query: Column, ids: Column) -> Column:
    """The key under which an answer is kept: a short hash of the query, and the ids in order."""
    return F.struct(F.substring(F.sha2(query, 256), 1, 16).alias("query"), F.array_sort(ids).alias("ids"))


def answer_mode(ids: Column) -> Column:
    """How a question is answered: over one patent, over several, or over all that are indexed if none is named."""
    n = F.size(F.coalesce(ids, F.array().cast("array<string>")))
    return F.when(n == 0, "multi_patent").when(n == 1, "single_patent").otherwise("multiple_patent")
