"""Queries of the retrieval operators: documents as records, embeddings as vectors, pages as fetched pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedex.functions import text as t
from remedex.operators import retrieval as r
from remedex.plans import query
from remedex.sources.tables import table

QUERY = ("reader", "the", "thation", "oration", "with")
_W = "[^\\x20\\x09-\\x0D]+"
_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9-]*')"
_HYPHEN = f"flatten(list_transform({_TOK}, lambda w: CASE WHEN contains(w, '-') THEN list_concat([w], list_filter(string_split(w, '-'), lambda p: p <> '')) ELSE [w] END))"
BM25 = f"""
d AS (SELECT doc_id AS id, {_HYPHEN} AS tk FROM documents),
t AS (SELECT count(*) AS nn, avg(len(tk)) AS av FROM d),
w AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(tk)) AS word FROM d) GROUP BY word),
i AS (SELECT word, ln(nn - n + 0.5::DOUBLE) - ln(n + 0.5::DOUBLE) AS idf FROM w, t),
m AS (SELECT avg(idf) AS mean FROM i),
q AS (SELECT x.word, coalesce(CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean ELSE idf END, 0.0::DOUBLE) AS idf FROM (VALUES {', '.join(f"('{w}')" for w in QUERY)}) x(word) LEFT JOIN i USING (word), m),
f AS (SELECT id, len(tk) AS l, word, idf, len(list_filter(tk, lambda y: y = word)) AS f FROM d, q),
s AS (SELECT id, sum(idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / av))) AS score FROM f, t GROUP BY id)"""


def scores(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), t.hyphen_tokens(F.col("text")).alias("tokens"))
    return r.bm25(docs, QUERY)


@query("patent_bm25", f"WITH {BM25} SELECT id, round(score, 7) AS score FROM s")
def patent_bm25(spark, d):
    return scores(spark, d).select("id", F.round("score", 7).alias("score"))


_RANKED = "bm AS (SELECT id, row_number() OVER (ORDER BY round(score, 7) DESC, id) AS rank FROM s), ap AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


@query("patent_rank_fusion", f"WITH {BM25}, {_RANKED}, u AS (SELECT * FROM bm WHERE rank <= 100 UNION ALL SELECT * FROM ap WHERE rank <= 100), z AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY id ORDER BY 2 DESC, 1 LIMIT 30) SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM z")
def patent_rank_fusion(spark, d):
    bm = r.ranked(scores(spark, d).select("id", F.round("score", 7).alias("score")), 100)
    ap = r.ranked(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score")), 100)
    f = r.fused(bm.select("id", "rank").unionByName(ap.select("id", "rank"))).select("id", F.round("score", 9).alias("score"))
    return r.ranked(f, 30)


@query("patent_pinned_rescale", f"WITH {BM25}, p AS (SELECT id, round(score + CASE WHEN id % 10 = 0 THEN 6 ELSE 0 END, 7) AS score FROM s) SELECT id, round(1 + 9 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM p")
def patent_pinned_rescale(spark, d):
    pinned = scores(spark, d).select("id", F.round(F.col("score") + F.when(F.col("id") % 10 == 0, 6).otherwise(0), 7).alias("score"))
    return r.rescaled(pinned).select("id", F.round("score", 6).alias("score"))


@query("patent_chunks", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
n AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, ceil((len(w) - 500) / 400) + 1)::INT END AS n FROM w), x AS (SELECT doc_id, w, unnest(range(n)) AS i FROM n)
SELECT doc_id, i::INT AS chunk_index, len(w[i * 400 + 1 : i * 400 + 500])::INT AS n_words, md5(array_to_string(w[i * 400 + 1 : i * 400 + 500], ' ')) AS digest FROM x""")
def patent_chunks(spark, d):
    c = r.chunks(table(spark, d, "documents").select("doc_id", "text"), F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return c.select("doc_id", "chunk_index", F.size(F.split("chunk_text", " ")).alias("n_words"), F.md5("chunk_text").alias("digest"))


@query("patent_chunk_weights", "SELECT source, CASE source WHEN 'src1' THEN 0.95::DOUBLE WHEN 'src2' THEN 0.7::DOUBLE ELSE 0.75::DOUBLE END AS weight, count(*) AS n, max(sha1(doc_id || '_' || source || '_0')) AS last_row FROM documents GROUP BY source")
def patent_chunk_weights(spark, d):
    section = F.when(F.col("source") == "src1", "abstract").when(F.col("source") == "src2", "background").otherwise(F.col("source"))
    row_id = F.sha1(F.concat_ws("_", F.col("doc_id").cast("string"), "source", F.lit("0")))
    return table(spark, d, "documents").groupBy("source").agg(F.max(r.chunk_weight(section)).alias("weight"), F.count("*").alias("n"), F.max(row_id).alias("last_row"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_COS = "(SELECT id, label, list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings))"


@query("patent_vector_topk", f"SELECT id, round(s, 9) AS score FROM {_COS} ORDER BY s DESC, id LIMIT 20")
def patent_vector_topk(spark, d):
    q = _vectors(spark, d).where("id = 0").first()["vector"]  # one query vector
    return r.nearest(_vectors(spark, d), q, 20).select("id", F.round("score", 9).alias("score"))


@query("patent_vector_per_label", f"WITH s AS (SELECT id, label, round(s * CASE WHEN id % 3 = 0 THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END, 9) AS score, row_number() OVER (PARTITION BY label ORDER BY s * CASE WHEN id % 3 = 0 THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END DESC, id)::INT AS rank FROM {_COS}) SELECT * FROM s WHERE rank <= 8")
def patent_vector_per_label(spark, d):
    q = _vectors(spark, d).where("id = 0").first()["vector"]
    out = r.nearest(_vectors(spark, d), q, 8, per="label", weight=F.when(F.col("id") % 3 == 0, 0.95).otherwise(0.8))
    return out.select("id", "label", F.round("score", 9).alias("score"), "rank")


@query("patent_store_cap", "WITH g AS (SELECT source, max(doc_id) AS t FROM documents GROUP BY source ORDER BY t DESC, source LIMIT 12) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM g)")
def patent_store_cap(spark, d):
    return r.newest_groups(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 12).select("doc_id", "source")


_TERMS = ["the", "and", "of", "zqx"]


@query("patent_relaxation", "WITH m AS (SELECT doc_id, CASE WHEN contains(x, 'the') AND contains(x, 'and') AND contains(x, 'of') AND contains(x, 'zqx') THEN 4 WHEN contains(x, 'the') AND contains(x, 'and') AND contains(x, 'of') THEN 3 WHEN contains(x, 'the') AND contains(x, 'and') THEN 2 WHEN contains(x, 'the') THEN 1 END AS rung FROM (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents)) SELECT doc_id, rung FROM m WHERE rung = (SELECT max(rung) FROM m)")
def patent_relaxation(spark, d):
    return r.relaxed(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), _TERMS).select("doc_id", "rung")


@query("patent_only_new", "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'stored' WHEN page_id % 5 = 0 THEN 'failed' ELSE 'indexed' END AS status FROM pages")
def patent_only_new(spark, d):
    ids = table(spark, d, "pages").select(F.col("page_id").alias("id"))
    return r.only_new(ids, ids.where("id % 3 = 0"), ids.where("id % 5 = 0"))


@query("patent_html_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def patent_html_titles(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), n("<a href=").alias("links"), n("<p[ >]").alias("paragraphs"))


@query("patent_ids", "SELECT p_partkey, 'US' || (2000000 + p_partkey) || 'B2' AS id, 'US2024' || lpad((100000 + p_partkey)::VARCHAR, 7, '0') || 'A1' AS canonical FROM part")
def patent_ids(spark, d):
    n = F.col("p_partkey")
    raw = F.concat(F.lit(" https://patents.google.com/patent/us"), F.format_number(2000000 + n, 0), F.lit(" b2/EN"))
    serial = F.concat(F.lit("US2024"), (100000 + n).cast("string"), F.lit("A1"))
    return table(spark, d, "part").select("p_partkey", t.patent_id(raw).alias("id"), t.canonical_patent_id(serial).alias("canonical"))


@query("patent_title_queries", r"""WITH q AS (SELECT item_id, trim(text) AS q, string_split_regex(trim(text), '\s+') AS w FROM benchmark) SELECT item_id, (q <> '' AND len(w) >= 4 AND lower(w[1]) NOT IN ('what', 'how', 'why', 'when', 'where', 'which', 'who', 'is', 'are', 'can', 'does', 'do') AND (contains(q, '-') OR len(list_filter(w, lambda x: length(x) > 2 AND regexp_matches(x, '^\p{Lu}'))) > 0)) AS title FROM q""")
def patent_title_queries(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.looks_like_title(F.col("text")).alias("title"))
