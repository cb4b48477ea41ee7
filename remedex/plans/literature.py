"""Queries of the literature operators: documents as articles, their sources as sections, frequent words as terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedex.functions import text as t
from remedex.operators import literature as lit
from remedex.plans import query
from remedex.sources.tables import table

CONCEPTS = (("the", "der", "les"), ("tion", "ung", "and"))
PHRASES = ("of the", "with", "in the", "and", "par")
_LONGEST = sorted(PHRASES, key=len, reverse=True)
_ANY = " AND ".join("(" + " OR ".join(f"contains(lower(s), '{w}')" for w in c) + ")" for c in CONCEPTS)
_REL = "CASE " + " ".join(f"WHEN regexp_matches(s, '(?i)(^|[^\\pL\\pN_])({p.replace(' ', chr(92) + 's+')})($|[^\\pL\\pN_])') THEN '{p}'" for p in _LONGEST) + " END"
_SECTION = "(CASE doc_id % 4 WHEN 0 THEN 'Abstract' WHEN 1 THEN '3. Results and Methods' WHEN 2 THEN 'references' ELSE source END)"
_WEIGHT = "CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END"
SENTENCES = r"""
p AS (SELECT doc_id, source, unnest(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])[\t\n\x0B\f\r ]+([A-Z(\[])', '\1' || chr(31) || '\2', 'g'), chr(31))) AS x FROM documents),
sn AS (SELECT doc_id, source, trim(x) AS s FROM p WHERE trim(x) <> '')"""
RELATED = f"rs AS (SELECT doc_id, s, {_REL} AS relation, {_WEIGHT} AS weight FROM sn WHERE {_ANY})"


def sections(spark, d):
    n = F.col("doc_id") % 4
    section = F.when(n == 0, "Abstract").when(n == 1, "3. Results and Methods").when(n == 2, "references").otherwise(F.col("source"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), section.alias("section"), F.coalesce("text", F.lit("")).alias("text"))


@query("lit_sentences", f"WITH {SENTENCES} SELECT doc_id AS id, count(*) AS n, max(length(s))::INT AS longest, md5(string_agg(s, '|' ORDER BY s)) AS digest FROM sn GROUP BY doc_id")
def lit_sentences(spark, d):
    s = sections(spark, d).select("id", F.explode(t.sentences(F.col("text"))).alias("s"))
    return s.groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("s")).alias("longest"), F.md5(F.array_join(F.array_sort(F.collect_list("s")), "|")).alias("digest"))


def related(spark, d):
    return lit.relation_sentences(sections(spark, d), CONCEPTS, PHRASES)


@query("lit_relation_sentences", f"WITH {SENTENCES}, {RELATED} SELECT doc_id AS id, coalesce(relation, '-') AS relation, weight, count(*) AS n FROM rs GROUP BY ALL")
def lit_relation_sentences(spark, d):
    return related(spark, d).groupBy("id", F.coalesce("relation", F.lit("-")).alias("relation"), "weight").agg(F.count("*").alias("n"))


_Q = ("the", "of", "la", "und", "que")
_SIM = "len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')), ['the', 'of', 'la', 'und', 'que'])) / (len(list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+'))) + 5.0::DOUBLE - len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')), ['the', 'of', 'la', 'und', 'que'])))"


def similar(spark, d):
    return t.jaccard(t.plain_tokens(F.col("sentence")), F.array(*map(F.lit, _Q)))


@query("lit_jaccard", f"WITH {SENTENCES} SELECT doc_id AS id, round(max(CASE WHEN len(regexp_extract_all(lower(s), '[a-z0-9]+')) > 0 THEN {_SIM} ELSE 0 END), 9) AS best FROM sn GROUP BY doc_id")
def lit_jaccard(spark, d):
    s = sections(spark, d).select("id", F.explode(t.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("id").agg(F.round(F.max(similar(spark, d)), 9).alias("best"))


_SCORES = f"""{SENTENCES}, {RELATED},
es AS (SELECT doc_id AS id, count(*) AS sentences, count(relation) AS relations, max(weight) FILTER (relation IS NOT NULL) AS w, max({_SIM}) FILTER (relation IS NOT NULL) AS sm, max(weight) AS aw FROM rs GROUP BY doc_id),
ev AS (SELECT id, sentences, relations, round(CASE WHEN relations > 0 THEN 100 * (0.4::DOUBLE + 0.25::DOUBLE * w + 0.2::DOUBLE * sm + 0.15::DOUBLE) ELSE 12.5::DOUBLE * aw END, 6) AS score FROM es)"""


def scores(spark, d):
    # The invented prose has no citations; the flag is set here so that the SQL need not look for markers.
    s = related(spark, d).withColumns({"similarity": similar(spark, d), "cited": F.lit(False)})
    return lit.evidence_scores(s).withColumn("score", F.round("score", 6))


@query("lit_evidence_scores", f"WITH {_SCORES} SELECT * FROM ev")
def lit_evidence_scores(spark, d):
    return scores(spark, d)


@query("lit_selected", f"WITH {_SCORES} SELECT * FROM ev WHERE relations > 0 AND (score >= 50 OR NOT EXISTS (SELECT 1 FROM ev WHERE relations > 0 AND score >= 50)) ORDER BY score DESC, id LIMIT 10")
def lit_selected(spark, d):
    return lit.selected(scores(spark, d))


_REQ, _CTX = ("the", "ation", "zqx"), ("und", "les")
_HIT = lambda col, words: " + ".join(f"contains({col}, '{w}')::INT" for w in words)


@query("lit_keyword_scores", f"""WITH x AS (SELECT doc_id AS id, lower(string_split(coalesce(text, ''), chr(10))[1]) AS ti, lower(coalesce(text, '')) AS tx FROM documents), h AS (SELECT id, {_HIT('tx', _REQ)} AS r, {_HIT('ti', _REQ)} AS rt, {_HIT('tx', _CTX)} AS c, {_HIT('ti', _CTX)} AS ct FROM x)
SELECT id, CASE WHEN r = 0 THEN 0.0::DOUBLE ELSE round(least(100.0::DOUBLE, 50.0::DOUBLE * r / 3 + 10 * rt + 20.0::DOUBLE * c / 2 + 10 * ct), 6) END AS score, (r + c)::INT AS n_matched FROM h""")
def lit_keyword_scores(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    out = lit.keyword_scores(docs, F.get(F.split("text", "\n"), 0), F.col("text"), _REQ, _CTX)
    return out.select("id", F.round("score", 6).alias("score"), F.size("matched").alias("n_matched"))


@query("lit_context_blocks", f"WITH {SENTENCES}, {RELATED} SELECT doc_id AS id, least(count(relation), 3) AS lines FROM rs GROUP BY doc_id HAVING count(relation) > 0")
def lit_context_blocks(spark, d):
    single = related(spark, d).withColumn("sentence", F.regexp_replace("sentence", "\n", " "))
    return lit.context_blocks(single).select("id", F.size(F.split("block", "\n")).cast("bigint").alias("lines"))


_TERM_ROWS = "SELECT n_regionkey AS grp, n_name AS term, n_nationkey AS pos FROM nation UNION ALL SELECT n_regionkey, lower(n_name), n_nationkey + 100 FROM nation"


@query("lit_expanded_terms", f"WITH t AS ({_TERM_ROWS}) SELECT grp, min_by(term, pos) AS term, min(pos)::INT AS pos FROM t GROUP BY grp, lower(term)")
def lit_expanded_terms(spark, d):
    return lit.expanded(_terms(spark, d)).withColumnRenamed("group", "grp")


def _terms(spark, d):
    n = table(spark, d, "nation")
    one = n.select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("term"), F.col("n_nationkey").alias("pos"))
    return one.unionByName(n.select(F.col("n_regionkey").alias("group"), F.lower("n_name").alias("term"), (F.col("n_nationkey") + 100).alias("pos")))


@query("lit_boolean_query", "SELECT n_regionkey AS grp, '(' || string_agg('\"' || n_name || '\"', ' OR ' ORDER BY n_nationkey) || ')' AS clause FROM nation GROUP BY n_regionkey")
def lit_boolean_query(spark, d):
    return lit.boolean_query(lit.expanded(_terms(spark, d))).withColumnRenamed("group", "grp")


@query("lit_mention_evidence", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'und')), n AS (SELECT nation.n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'of' WHEN 1 THEN 'for' ELSE 'zqx' || n_nationkey END AS word FROM nation) SELECT id, count(DISTINCT doc_id) AS articles, CASE WHEN count(doc_id) > 0 THEN 'evidence-backed' ELSE 'score-only' END AS strength FROM n LEFT JOIN w USING (word) GROUP BY id")
def lit_mention_evidence(spark, d):
    k = F.col("n_nationkey")
    names = table(spark, d, "nation").select(k.alias("id"), F.when(k % 3 == 0, F.lit("of")).when(k % 3 == 1, F.lit("for")).otherwise(F.concat(F.lit("zqx"), k.cast("string"))).alias("word"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return lit.mention_evidence(docs, names, ("the", "und"))
