"""How far the sources of a language lie apart, and the terms that mark each of them, by DuckDB over shards.

1. Each task counts the terms of its documents by (lang, source): occurrences and documents with the term.  A row holds
   all sources of one (lang, term), so a term in every document is one row for each chunk of a task.
2. Rows are dealt to shards by the hash of lang and term.  A shard is a DuckDB query over its Arrow stream: sums by
   (lang, term, source), and the terms in at least ``LEAST`` documents of their language.
3. Spark sums the totals of each group and language and joins them to the kept counts, which go to shards again.
4. In a shard, DuckDB computes all p in vectors, the best ten terms of each group, and partial sums for each pair of sources
   over the terms that both hold.  Spark merges sums and ranks.

A pair's value runs over all kept terms, those without occurrences too.  With a0 and b0 the p of an absent term,
f(a,b) = f(a0,b0) + [f(a,b0) - f(a0,b0)] + [f(a0,b) - f(a0,b0)] + [f(a,b) - f(a,b0) - f(a0,b) + f(a0,b0)]; the last part
is 0 unless both hold the term (step 4), and the two before it need only how many terms a group has with each count.

Everything is in integers, wider than 64 bits where a count is scaled.

Defined cases: null text, lang and source are ''; every row is a document, repeated rows count each time; a group without
terms has its pairs, and no terms; without kept terms in a language all its pairs have value 0; a source alone in its
language has no pair; equal values rank by UTF-8; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.llm.common import Numbers, Scratch, counted, parallelism, separators, small_batches, table, texts_of

NAME = "op11_source_divergence"
LEAST, SHOWN, SCALE = 10, 10, 1_000_000_000
CHUNK = 24 << 20  # bytes of text that a task counts before it hands on its sums
ROWS = 10_000  # rows of an Arrow batch
MEMORY = "500MB"
_TABLE = separators(digits=False)

_KEPT = """
WITH counts AS (SELECT lang, term, unnest(sources) AS source, unnest(counts) AS n, unnest(docs) AS d FROM shard),
summed AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(d) AS d FROM counts GROUP BY ALL),
kept AS (SELECT lang, term FROM summed GROUP BY ALL HAVING sum(d) >= {least})
SELECT lang, source, term, n FROM summed SEMI JOIN kept USING (lang, term)
"""
_SCORED = """
CREATE TEMP TABLE scored AS
SELECT lang, source, term, zero, (1 + {scale}::HUGEINT * (n + 2) // (total + 2 * v))::BIGINT AS p,
  (1 + {scale}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2) // (lang_total + 2 * v))::BIGINT AS q FROM shard
"""
_TERMS = """
SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM scored WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {shown}
"""
_PAIRS = """
SELECT lang, a.source AS source, 'pair' AS part, b.source AS item,
  sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p) - (a.p - b.zero) * (a.p - b.zero) // (a.p + b.zero)
    - (a.zero - b.p) * (a.zero - b.p) // (a.zero + b.p) + (a.zero - b.zero) * (a.zero - b.zero) // (a.zero + b.zero))::BIGINT AS value
FROM scored a JOIN scored b USING (lang, term) WHERE a.source < b.source GROUP BY ALL
"""


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, term, and by source the occurrences and the documents with it, summed within chunks of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Chunk()
        for b in batches:
            held.add(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)))
            if held.bytes > CHUNK:
                yield from held.sums()
                held = _Chunk()
        yield from held.sums()

    small_batches(docs.sparkSession)
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*empty).mapInArrow(run, "lang string, term string, sources array<string>, counts array<bigint>, docs array<bigint>")


class _Chunk:
    """Counts of the terms of some documents by (lang, source)."""

    def __init__(self):
        self.bytes, self.terms, self.groups, self.keys, self.sizes = 0, Numbers(), {}, [], []

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        number, n = self.terms.of([t.translate(_TABLE).split() for t in texts])
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], dtype=np.int64)
        # Distinct terms of each document first, then those of each group.
        pairs, tf = counted(np.repeat(np.arange(len(n)), n) << 32 | number)
        self.keys.append(group[pairs >> 32] << 32 | pairs & 0xFFFFFFFF)
        self.sizes.append(tf)
        self.bytes += sum(map(len, texts))

    def sums(self) -> Iterator[pa.RecordBatch]:
        keys, tf = np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.sizes])
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, tf = keys[order], tf[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n, docs, group, term = np.add.reduceat(tf, at), np.diff(np.append(at, len(keys))), keys[at] >> 32, keys[at] & 0xFFFFFFFF
        names = list(self.groups)
        langs = sorted({x for x, _ in names})
        lang = np.array([langs.index(x) for x, _ in names], dtype=np.int64)[group]
        order = np.argsort(lang << 32 | term, kind="stable")
        n, docs, group, key = n[order], docs[order], group[order], (lang << 32 | term)[order]
        at = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        words, sources = pa.array(list(self.terms.number), pa.binary()).cast(pa.string()), pa.array([s for _, s in names], pa.string())
        for lo in range(0, len(at) - 1, ROWS):
            some = at[lo : lo + ROWS + 1]
            part, first = slice(some[0], some[-1]), key[some[:-1]]
            offsets = pa.array((some - some[0]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (sources.take(pa.array(group[part])), pa.array(n[part]), pa.array(docs[part]))]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(first >> 32)), words.take(pa.array(first & 0xFFFFFFFF)), *lists], ["lang", "term", "sources", "counts", "docs"])


def _in_shards(rows: DataFrame, made: list[str], asked: list[str], schema: str) -> DataFrame:
    """The results of DuckDB queries over the rows of each shard, which they see as the view ``shard``; ``made`` come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return

        def stream() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with tempfile.TemporaryDirectory() as own, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": own}) as db:  # what DuckDB spills in this task
            db.register("shard", pa.RecordBatchReader.from_batches(first.schema, stream()))
            for sql in made:
                db.execute(sql)
            for sql in asked:
                yield from db.sql(sql).to_arrow_reader(ROWS)

    return rows.repartition(parallelism(rows.sparkSession), "lang", "term").mapInArrow(run, schema)


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n of the kept terms that occur in the group."""
    return _in_shards(term_counts(docs), [], [_KEPT.format(least=least)], "lang string, source string, term string, n long")


def _divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def audit(docs: DataFrame, scratch: Scratch, least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = scratch.put(kept_counts(docs, least), "kept")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("v"))
    groups = groups.join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "lang_total", "v"])
    groups = scratch.put(groups.withColumn("zero", F.expr(f"1 + {2 * SCALE} div greatest(total + 2 * v, 1)")), "groups")
    full = kept.join(groups, ["lang", "source"])
    # Partial results of the shards: best terms, and sums over the terms that both sources of a pair hold.
    asked = [_TERMS.format(shown=shown), _PAIRS]
    parts = scratch.put(_in_shards(full, [_SCORED.format(scale=SCALE)], asked, "lang string, source string, part string, item string, value long"), "parts")
    # What a group's own terms add against every other source, by the counts that occur.
    p = f"cast(1 + cast({SCALE} as decimal(38, 0)) * (n + 2) div (total + 2 * v) as bigint)"
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(groups, ["lang", "source"])
    own = own.select("lang", "source", "zero", "k", F.expr(p).alias("p"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    none = F.expr(_divergence("zero", "other"))
    own = own.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (F.expr(_divergence("p", "other")) - none)).alias("value"))
    turned = lambda x: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    both = parts.where("part = 'pair'").select("lang", "source", "item", "value")
    absent = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * none).alias("value"))
    pairs = absent.unionByName(own).unionByName(turned(own)).unionByName(both).unionByName(turned(both))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    out = pairs.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= shown)).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), Scratch(spark))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10),
n AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
total AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 2) // (coalesce(total, 0) + 2 * v))::BIGINT AS p
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)))::BIGINT AS q FROM n JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""
