"""Evidence from texts: term expansion, relation sentences, their scores, keyword gates and the selection of articles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.functions import text as t

# How the parts of an evidence score weigh.
WEIGHTS = {"relation": 0.40, "position": 0.25, "similarity": 0.20, "primary": 0.15}


def expanded(terms: DataFrame) -> DataFrame:
    """(group, term, pos) rows once for each term, ignoring case; the first by pos stays."""
    rank = F.row_number().over(W.partitionBy("group", F.lower(F.trim("term"))).orderBy("pos"))
    return terms.where(F.trim("term") != "").withColumn("_n", rank).where("_n = 1").select("group", F.trim("term").alias("term"), "pos")


def boolean_query(terms: DataFrame, most: int = 25, longest: int = 60, spaces: int = 6) -> DataFrame:
    """group, clause: the first terms of a group joined by OR; long ones and those of many words are left out."""
    ok = (F.length("term") <= longest) & (F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit(""))) <= spaces)
    rank = F.row_number().over(W.partitionBy("group").orderBy("pos"))
    kept = terms.where(ok).withColumn("_n", rank).where(F.col("_n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit('"'), F.col("term"), F.lit('"')).alias("q"))))  # at most ``most``
    return kept.groupBy("group").agg(F.concat(F.lit("("), F.array_join(F.transform(listed, lambda x: x["q"]), " OR "), F.lit(")")).alias("clause"))


def relation_sentences(sections: DataFrame, concepts: Sequence[Sequence[str]], phrases: Sequence[str] = t.RELATIONS) -> DataFrame:
    """The sentences of (id, section, text) rows that name a term of every concept, with their relation phrase, whether
    they report their own finding, and the weight of their section."""
    s = sections.select("id", "section", F.posexplode(t.sentences(F.col("text"))).alias("place", "sentence"))
    named = reduce(lambda a, b: a & b, [F.size(t.terms_in(F.col("sentence"), c)) > 0 for c in concepts])
    s = s.where(named).withColumn("relation", t.relation_phrase(F.col("sentence"), phrases))
    at = t.phrase_place(F.col("sentence"), F.col("relation"))
    cited = t.is_cited(F.col("sentence"), F.coalesce(at, F.lit(0)), F.coalesce(F.length("relation"), F.lit(0)))
    return s.withColumns({"cited": cited, "weight": t.section_weight(F.col("section"))})


def evidence_scores(sentences: DataFrame) -> DataFrame:
    """Score out of 100 of each id, from rows with relation, cited, weight and similarity: sentences with a relation
    count fully, mere mentions by an eighth of their best weight."""
    rel = F.col("relation").isNotNull()
    best = lambda c: F.max(F.when(rel, F.col(c)))
    out = sentences.groupBy("id").agg(
        F.count("*").alias("sentences"),
        F.count("relation").alias("relations"),
        best("weight").alias("_w"),
        best("similarity").alias("_s"),
        F.max(F.when(rel & ~F.col("cited"), 1).otherwise(0)).alias("_p"),
        F.max("weight").alias("_any"),
    )
    full = 100 * (WEIGHTS["relation"] + WEIGHTS["position"] * F.col("_w") + WEIGHTS["similarity"] * F.col("_s") + WEIGHTS["primary"] * F.col("_p"))
    score = F.when(F.col("relations") > 0, full).otherwise(12.5 * F.col("_any"))
    return out.select("id", "sentences", "relations", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"))


def keyword_scores(docs: DataFrame, title: Column, text: Column, required: Sequence[str], context: Sequence[str]) -> DataFrame:
    """id, score, matched: share of the required words found, words in the title and context; 0 if none is found."""
    low_title, low = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.concat_ws(" ", title, text))
    count = lambda where, words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(where, w)))
    hits = count(low, required)
    score = 50 * hits / len(required) + 10 * count(low_title, required)
    if context:
        score = score + 20 * count(low, context) / len(context) + 10 * count(low_title, context)
    matched = F.filter(F.array(*map(F.lit, [*required, *context])), lambda w: F.contains(low, w))
    return docs.select("id", F.when(hits == 0, 0.0).otherwise(F.least(F.lit(100.0), score)).alias("score"), F.array_distinct(matched).alias("matched"))


def selected(scores: DataFrame, top: int = 10, least: float = 50.0) -> DataFrame:
    """The best rows with a relation and the least score; if there are none, the best of all with a relation."""
    own = scores.where("relations > 0")
    good = own.agg(F.coalesce(F.max(F.col("score") >= least), F.lit(False)).alias("_any"))  # one row
    kept = own.crossJoin(F.broadcast(good)).where(~F.col("_any") | (F.col("score") >= least)).drop("_any")
    return kept.orderBy(F.col("score").desc(), "id").limit(top)


def context_blocks(sentences: DataFrame, per_id: int = 3) -> DataFrame:
    """id, block: the heaviest relation sentences of each id, in text order, one to a line."""
    best = F.row_number().over(W.partitionBy("id").orderBy(F.col("weight").desc(), "section", "place"))
    head = sentences.where("relation IS NOT NULL").withColumn("_n", best).where(F.col("_n") <= per_id)
    listed = F.array_sort(F.collect_list(F.struct("section", "place", "sentence")))  # at most ``per_id``
    return head.groupBy("id").agg(F.array_join(F.transform(listed, lambda x: x["sentence"]), "\n").alias("block"))


def cited_ids(answer: Column, supplied: Column) -> Column:
    """Numbers of a text that are among the supplied ids, in order and once."""
    return F.array_intersect(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\b(\d+)\b"), 1)), supplied)


def mention_evidence(articles: DataFrame, names: DataFrame, context: Sequence[str]) -> DataFrame:
    """id, articles: how many texts (doc, text) name each candidate (id, word) as a word and any context term.

    Words of texts and names meet in an equi-join, so a name is not tried against every text.
    """
    low = F.lower(F.col("text"))
    near = articles.where(F.exists(F.array(*map(F.lit, context)), lambda c: F.contains(low, c)))
    words = near.select("doc", F.explode(F.array_distinct(t.plain_tokens(F.col("text")))).alias("word"))
    hit = words.join(names.select("id", F.lower("word").alias("word")), "word")
    counted = hit.groupBy("id").agg(F.count_distinct("doc").alias("articles"))
    return names.select("id").distinct().join(counted, "id", "left").na.fill(0, ["articles"]).withColumn("strength", F.when(F.col("articles") > 0, "evidence-backed").otherwise("score-only"))
