"""Queries of what is kept between requests: scores, session answers, indexes and caches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.operators import advice
from remedex.operators.numbered import layered_weights, numbered
from remedex.operators.walks import converged
from remedex.plans import graph as base
from remedex.plans import query
from remedex.sources import flat, nested
from remedex.sources.batches import Batches
from remedex.sources.caches import KeyedCache
from remedex.sources.scores import ScoreCache, graph_version
from remedex.sources.settle import new_folder, stored
from remedex.sources.statements import StatementTable
from remedex.sources.tables import spread, table
from remedex.sources.vectors import VectorStore, codebook

_FIRST, _SECOND = ["N3", "N5"], ["N3", "N5", "N7"]


@query("kg_cached_scores", f"""WITH RECURSIVE {base.EDGES}, {base.WEIGHTS}, wm AS MATERIALIZED (SELECT * FROM w),
walk(step, seed, id, p) AS (SELECT 0, s, s, 1.0::DOUBLE FROM (SELECT unnest({_SECOND}) AS s) UNION ALL
  SELECT step + 1, seed, id, sum(p) FROM (SELECT step, seed, wm.dst AS id, p * w * 0.7::DOUBLE AS p FROM walk JOIN wm ON wm.src = walk.id UNION ALL SELECT DISTINCT step, seed, seed, 0.3::DOUBLE FROM walk) WHERE step < 100 GROUP BY step, seed, id),
z AS (SELECT seed, id, round(p, 9) AS p, row_number() OVER (PARTITION BY seed ORDER BY round(p, 9) DESC, id) AS rank FROM walk WHERE step = 100 AND id LIKE 'P%')
SELECT seed, CASE WHEN seed IN ('N3', 'N5') THEN 1::BIGINT ELSE 2::BIGINT END AS number, rank::INT AS rank, id, p FROM z WHERE rank <= 10""")
def kg_cached_scores(spark, d):
    """A request for two seeds, then one for three: the second walks only from the third (``number`` is the request)."""
    cache, version = ScoreCache(spark, new_folder(spark)), graph_version(base.edges(spark, d), restart=0.3, jump=0.5)
    names, ends = numbered(base.triples(spark, d), base.KIND)
    weights = stored(layered_weights(names, ends))

    def compute(seeds):
        p = converged(weights, seeds.join(names, "id").select("seed", F.col("n").alias("id"), "p"))
        return p.withColumnRenamed("id", "n").join(names, "n").select("seed", "id", "p")

    cache.scores(version, _FIRST, compute)
    found = cache.scores(version, _SECOND, compute).where(base.KIND(F.col("id")) == "P").withColumn("p", F.round("p", 9))
    rank = F.row_number().over(W.partitionBy("seed").orderBy(F.col("p").desc(), "id"))
    return found.withColumn("rank", rank).where("rank <= 10").select("seed", "number", "rank", "id", "p")


_SESSIONS = "h AS (SELECT 'N' || s_nationkey AS session, 'S' || s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 5000 THEN 'known' ELSE 'hidden' END AS category, s_acctbal AS score FROM supplier)"


@query("target_followup", f"""WITH {_SESSIONS}, q AS (SELECT 'N' || c_nationkey AS session, 's' || c_custkey AS asked FROM customer UNION ALL SELECT 'N99', 's1')
SELECT q.session, q.asked, CASE WHEN h.id IS NOT NULL THEN 'answered' WHEN q.session IN (SELECT session FROM h) THEN 'not among the candidates' ELSE 'no such session' END AS status, h.id, h.score,
h.name || ' (' || h.id || ') is labelled ' || h.category || CASE WHEN h.category = 'known' THEN ': a curated edge links them.' ELSE ': no curated edge links them, and its score clears the threshold.' END AS explanation
FROM q LEFT JOIN h ON h.session = q.session AND lower(h.id) = lower(q.asked)""")
def target_followup(spark, d):
    """Questions about single candidates, answered from the stored scores of their sessions; nothing is scored again."""
    scored = table(spark, d, "supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("session"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 5000, "known").otherwise("hidden").alias("category"), F.col("s_acctbal").alias("score"),
    )
    store = Batches(spark, new_folder(spark), "session string, id string, name string, category string, score double", "sessions long")
    store.commit(store.write(scored), 1, [(25,)])
    asked = table(spark, d, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("session"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("asked"))
    asked = asked.unionByName(spark.createDataFrame([("N99", "s1")], "session string, asked string"))
    return advice.followed_up(store.read(), asked).select("session", "asked", "status", "id", "score", "explanation")


@query("build_unique_statements", "SELECT DISTINCT 'P' || l_partkey AS source, 'part_supplier' AS edge_type, 'S' || l_suppkey AS target FROM lineitem")
def build_unique_statements(spark, d):
    """Statements of two overlapping parts of a table, the first of them written again: each is there once."""
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"), F.lit("part_supplier").alias("edge_type"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"), "l_returnflag")
    t = StatementTable(spark, new_folder(spark), "source string, edge_type string, target string")
    for kinds in (("A", "N"), ("A", "N"), ("N", "R")):
        t.write(rows.where(F.col("l_returnflag").isin(*kinds)).drop("l_returnflag"))
    return t.read()


@query("app_cached_answers", """WITH e AS (SELECT event_id, 'u' || user_id AS key, event_type AS value, ts::DATE AS day FROM events), b AS (SELECT *, dense_rank() OVER (ORDER BY day) AS batch FROM e),
last AS (SELECT key, max(batch) AS batch, max(day) AS day FROM b WHERE batch <= 3 GROUP BY key), v AS (SELECT b.key, max(b.value) AS value, any_value(last.batch) AS batch, any_value(last.day) AS day FROM b JOIN last ON last.key = b.key AND last.batch = b.batch GROUP BY b.key)
SELECT key, value FROM (SELECT *, row_number() OVER (ORDER BY batch DESC, key) AS n, max(day) OVER () AS now FROM v) WHERE n <= 40 AND day >= now - 1""")
def app_cached_answers(spark, d):
    """Three days of answers kept for a day more, at most 40 of them: what a request for all of them finds."""
    events = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.to_date("ts").alias("day"))
    days = [r["day"] for r in events.select("day").distinct().orderBy("day").limit(3).collect()]
    cache = KeyedCache(spark, new_folder(spark), days=1, most=40)
    for day in days:
        cache.put(events.where(F.col("day") == F.lit(day)).select("key", "value"), F.lit(day).cast("timestamp"))
    return cache.get(events.select("key"), F.lit(days[-1]).cast("timestamp"))


@query("patent_index_topk", """WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 3 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS x FROM embeddings),
k AS (SELECT label FROM v GROUP BY label ORDER BY min(vec_id + CASE WHEN vec_id % 7 = 3 THEN 1000000 ELSE 0 END) DESC, label::VARCHAR LIMIT 20),
s AS (SELECT q.vec_id AS query, v.vec_id::VARCHAR AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.x), 9) AS score FROM embeddings q, v WHERE q.vec_id % 50 = 0 AND v.label IN (SELECT label FROM k))
SELECT query, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def patent_index_topk(spark, d):
    """The nearest vectors of every fiftieth one, in an index whose rows were replaced in part and whose oldest owners were evicted."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("owner"), F.lit("claims").alias("section"), F.col("embedding").cast("array<double>").alias("vector"), F.lit("").alias("payload"), F.col("vec_id").alias("added"))
    store = VectorStore(spark, new_folder(spark), codebook(v, 24))
    store.upsert(v)
    store.upsert(v.where("added % 7 = 3").withColumns({"vector": F.transform("vector", lambda x: -x), "added": F.col("added") + 1_000_000}))
    store.evict(20)
    queries = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = store.search(queries, 30).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "id"))  # scores that agree to nine digits rank by id
    return found.withColumn("rank", rank).where("rank <= 10").select("query", "id", "score", "rank")


_PROTEIN = """concat('ID   ', p_brand, '_HUMAN   Reviewed;', chr(10), 'AC   P', p_partkey, '; A', p_size, ';', chr(10), 'AC   B', p_partkey, ';', chr(10), 'DE   RecName: Full=', p_name, ';', chr(10), 'DE     Short=s', p_size, ';', chr(10),
 'OX   NCBI_TaxID=', CASE WHEN p_partkey % 5 = 0 THEN '77' ELSE '9606' END, ';', chr(10), 'RX   PubMed=', p_size, ';', chr(10), 'CC   -!- FUNCTION: Q11111.', chr(10), 'CC   -!- INTERACTION:', chr(10), 'CC       Q2222', p_partkey % 10, '; x', chr(10),
 'DR   GO; GO:', p_size, '; ', substr('FPC', 1 + p_partkey % 3, 1), ':y.', chr(10), 'DR   InterPro; I', p_partkey % 4, '; z.', chr(10), 'KW   ', p_type, '.', chr(10), 'SQ   SEQ', chr(10), '     MK')"""


@query("build_protein_entries", """WITH p AS (SELECT 'P' || p_partkey AS source, * FROM part WHERE p_partkey % 5 <> 0),
x AS (SELECT 'metadata' AS kind, source, 'OTHER_ID' AS edge_type, 'B' || p_partkey AS target FROM p UNION ALL SELECT 'metadata', source, 'NAME', split_part(p_brand, '_', 1) FROM p UNION ALL SELECT 'metadata', source, 'SPECIES', 'HUMAN' FROM p
UNION ALL SELECT 'metadata', source, 'FULL_NAME', trim(p_name) FROM p UNION ALL SELECT 'metadata', source, 'SHORT_NAME', 's' || p_size FROM p UNION ALL SELECT 'metadata', source, 'RELATED_PUBMED_ID', 'pubmed:' || p_size FROM p UNION ALL SELECT 'metadata', source, 'RELATED_KEYWORD', p_type FROM p
UNION ALL SELECT 'facts', source, CASE p_partkey % 3 WHEN 0 THEN 'GO_BP' WHEN 1 THEN 'GO_MF' ELSE 'GO_CC' END, 'GO:' || p_size FROM p UNION ALL SELECT 'facts', source, CASE p_partkey % 4 WHEN 0 THEN 'FAMILY' ELSE 'DOMAIN' END, 'I' || p_partkey % 4 FROM p WHERE p_partkey % 4 < 2
UNION ALL SELECT 'interactions', source, 'INTERACTS_WITH', 'Q2222' || p_partkey % 10 FROM p)
SELECT kind, source, edge_type, target FROM x""")
def build_protein_entries(spark, d):
    texts = spread(table(spark, d, "part"), "p_partkey").select(F.expr(_PROTEIN).alias("value"))
    return flat.protein_statements(texts, spark.createDataFrame([("I0", "Family"), ("I1", "Domain")], "family string, family_type string"))


@query("build_cell_lines", """SELECT 'CVCL_' || p_partkey AS code, replace(p_name, '#', '') || ',syn ' || p_size || ',S2' AS names, CASE WHEN p_partkey % 2 = 0 THEN 'Homo sapiens,Mus musculus' ELSE 'unknown' END AS species, CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE 'Female' END AS sex,
' C1; ' || p_type AS disease, CASE WHEN p_partkey % 4 = 0 THEN 'GSM' || p_partkey || ',GSM0' ELSE '' END AS datasets, p_size || ',7' AS publications FROM part""")
def build_cell_lines(spark, d):
    ox = "CASE WHEN p_partkey % 2 = 0 THEN concat('OX   T=9606; ! Homo sapiens', chr(10), 'OX   T=1; ! Mus musculus', chr(10)) ELSE '' END"
    geo = "CASE WHEN p_partkey % 4 = 0 THEN concat('DR   GEO; GSM', p_partkey, chr(10), 'DR   GEO; GSM0', chr(10)) ELSE '' END"
    text = f"concat('-- head', chr(10), 'ID   #', p_name, chr(10), 'AC   CVCL_', p_partkey, chr(10), 'SY   syn ', p_size, '; S2', chr(10), {geo}, 'RX   PubMed=', p_size, '; PubMed=7;', chr(10), 'DI   NCIt; C1; ', p_type, chr(10), {ox}, 'SX   ', CASE WHEN p_partkey % 3 = 0 THEN 'Sex unspecified' ELSE 'Female' END, chr(10))"
    cells = flat.cell_lines(table(spark, d, "part").select(F.expr(text).alias("value")))
    return cells.select("code", F.array_join("names", ",").alias("names"), "species", "sex", "disease", F.array_join("datasets", ",").alias("datasets"), F.array_join("publications", ",").alias("publications"))


_DRUG = """concat('<drug><drugbank-id primary="true">D', p_partkey, '</drugbank-id><drugbank-id>X</drugbank-id><name>', p_name, '</name><groups><group>approved</group></groups>
<targets><target><references><articles><article><pubmed-id>', p_size, '</pubmed-id></article></articles></references><actions><action>', p_brand, '</action><action>other</action></actions><polypeptide id="P', p_size, '" source="Swiss-Prot"/></target></targets>
<enzymes><enzyme><polypeptide id="X" source="T"><external-identifiers><external-identifier><resource>UniprotKB</resource><identifier>Q', p_size, '</identifier></external-identifier></external-identifiers></polypeptide></enzyme></enzymes>
<drug-interactions><drug-interaction><drugbank-id>D', p_partkey + 1, '</drugbank-id><description>The risk or severity of bleeding can be increased when A is combined with B.</description></drug-interaction></drug-interactions>
<atc-codes><atc-code code="B01AE02"/></atc-codes><categories><category><mesh-id>M', p_size, '</mesh-id></category></categories>
<pathways><pathway><smpdb-id>W', p_partkey % 7, '</smpdb-id><category>c</category><enzymes><uniprot-id>P1</uniprot-id></enzymes></pathway></pathways></drug>')"""


@query("build_drug_tables", """WITH p AS (SELECT 'D' || p_partkey AS id, * FROM part), x AS (SELECT 'meta' AS kind, id AS source, 'TYPE' AS edge_type, 'DRUG' AS target, NULL AS qualifier, NULL AS "references" FROM p
UNION ALL SELECT 'meta', id, 'NAME', regexp_replace(trim(p_name), '[^a-zA-Z0-9]', '_', 'g'), NULL, NULL FROM p UNION ALL SELECT 'stage', id, 'PRODUCT_STAGE', 'approved', NULL, NULL FROM p
UNION ALL SELECT 'target', id, 'DRUG_TARGET', 'P' || p_size, unnest([regexp_replace(p_brand, '[^a-zA-Z0-9]', '_', 'g'), 'unknown']), p_size::VARCHAR FROM p UNION ALL SELECT 'target', id, 'DRUG_ENZYME', 'Q' || p_size, 'unknown', NULL FROM p
UNION ALL SELECT 'interaction', id, 'DRUG_INTERACTION', 'D' || (p_partkey + 1), 'increase_bleeding', NULL FROM p UNION ALL SELECT 'atc', id, 'DRUG_ATC', unnest(['ATC:B', 'ATC:B01', 'ATC:B01A', 'ATC:B01AE', 'ATC:B01AE02']), NULL, NULL FROM p
UNION ALL SELECT 'mesh', id, 'MESH_CATEGORY', 'M' || p_size, NULL, NULL FROM p UNION ALL SELECT 'pathway', id, 'DRUG_PATHWAY', 'W' || p_partkey % 7, NULL, NULL FROM p
UNION ALL SELECT 'pathway', 'W' || p_partkey % 7, 'PATHWAY_CATEGORY', 'c', NULL, NULL FROM p UNION ALL SELECT 'pathway', 'W' || p_partkey % 7, 'PATHWAY_ENZYME', 'P1', NULL, NULL FROM p)
SELECT kind, source, edge_type, target, qualifier, "references" FROM x""")
def build_drug_tables(spark, d):
    entries = spread(table(spark, d, "part"), "p_partkey").select(F.from_xml(F.expr(_DRUG), nested.DRUG, {"rowTag": "drug"}).alias("e")).select("e.*")
    return nested.drug_statements(entries)
