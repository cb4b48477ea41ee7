"""Ranking of texts: BM25, rank fusion, rescaling, chunks, vector search, store caps and query relaxation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.functions.text import cosine

# How much a section of a record counts.
CHUNK_WEIGHTS = {"independent_claims": 1.0, "abstract": 0.95, "summary": 0.9, "dependent_claims": 0.85, "metadata": 0.85, "description": 0.8, "background": 0.7}
OTHER_CHUNK = 0.75


def bm25(tokens: DataFrame, query: Sequence[str], k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """id, score of every text (id, tokens) for the query's words, repeats counted; negative idf becomes ``floor`` times
    the mean idf of the vocabulary.

    Document frequencies come from one aggregation over distinct words of a text; term frequencies are counted inside
    the row, so only (word, count) rows are shuffled.
    """
    docs = tokens.select("id", F.size("tokens").alias("len"), *[F.size(F.filter("tokens", lambda t: t == F.lit(q))).alias(f"_f{i}") for i, q in enumerate(query)])
    totals = tokens.agg(F.count("*").alias("texts"), F.avg(F.size("tokens")).alias("avg"))  # one row
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    idf = df.crossJoin(totals).withColumn("idf", F.log(F.col("texts") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    wanted = [F.max(F.when(F.col("word") == q, F.col("idf"))).alias(f"_i{i}") for i, q in enumerate(query)]
    stats = idf.agg(F.avg("idf").alias("mean"), *wanted).crossJoin(totals)  # one row
    score = F.lit(0.0)
    for i in range(len(query)):
        f, w = F.col(f"_f{i}"), F.coalesce(f"_i{i}", F.lit(0.0))
        w = F.when(w < 0, floor * F.col("mean")).otherwise(w)
        score = score + w * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return docs.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row


def fused(rankings: DataFrame, k: int = 60) -> DataFrame:
    """id, score: the sum of 1 / (k + rank) over the lists (id, rank) that hold it."""
    return rankings.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def rescaled(scored: DataFrame, low: float = 1.0, high: float = 10.0) -> DataFrame:
    """Scores mapped linearly to [low, high]; equal scores all to ``low``."""
    ends = scored.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))  # one row
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    return scored.crossJoin(F.broadcast(ends)).withColumn("score", low + (high - low) * (F.col("score") - F.col("_lo")) / span).drop("_lo", "_hi")


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The best rows with their rank; equal scores by id.  Only ``top`` rows are ranked in one task."""
    best = scored.orderBy(F.col("score").desc(), "id").limit(top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "id")))


def chunks(docs: DataFrame, text: Column, size: int = 500, overlap: int = 100, most: int | None = None) -> DataFrame:
    """Windows of words with an overlap, the last one ending at the text's end; columns chunk_index, chunk_text."""
    stride = size - overlap
    w = docs.withColumn("_w", F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    n = F.when(F.size("_w") == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((F.size("_w") - size) / stride) + 1))
    if most:
        n = F.least(n, F.lit(most))
    w = w.withColumn("_n", n.cast("int")).where("_n > 0")
    w = w.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return w.withColumn("chunk_text", F.array_join(F.slice("_w", F.col("chunk_index") * stride + 1, size), " ")).drop("_w", "_n")


def chunk_weight(section: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CHUNK_WEIGHTS.items() for x in kv]), section), F.lit(OTHER_CHUNK))


def nearest(vectors: DataFrame, query: Sequence[float], top: int, per: str | None = None, weight: Column | None = None) -> DataFrame:
    """The rows (id, vector) nearest to a query by cosine, times a weight; ``per`` keeps the best of each group."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.withColumn("score", cosine(F.col("vector"), q) * (weight if weight is not None else F.lit(1.0)))
    if per is None:
        return s.orderBy(F.col("score").desc(), "id").limit(top)
    return s.withColumn("rank", F.row_number().over(W.partitionBy(per).orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= top)


def newest_groups(rows: DataFrame, group: str, inserted: str, cap: int) -> DataFrame:
    """Rows of the ``cap`` groups that came last; older groups are evicted whole."""
    last = rows.groupBy(group).agg(F.max(inserted).alias("_t")).orderBy(F.col("_t").desc(), group).limit(cap)
    return rows.join(F.broadcast(last.select(group)), group, "left_semi")  # ``cap`` rows


def relaxed(docs: DataFrame, text: Column, terms: Sequence[str], rungs: Sequence[int] = (3, 2, 1)) -> DataFrame:
    """The texts of the strictest rung that any text meets: all terms, else the first 3, 2, 1.  Adds ``rung``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    sizes = sorted({len(terms), *[r for r in rungs if r < len(terms)]}, reverse=True)
    meets = lambda n: F.forall(F.array(*map(F.lit, terms[:n])), lambda t: F.contains(low, t))
    rung = F.coalesce(*[F.when(meets(n), F.lit(n)) for n in sizes])
    marked = docs.withColumn("rung", rung).where("rung IS NOT NULL")
    best = marked.agg(F.max("rung").alias("_r"))  # one row
    return marked.crossJoin(F.broadcast(best)).where("rung = _r").drop("_r")


def only_new(wanted: DataFrame, stored: DataFrame, failed: DataFrame) -> DataFrame:
    """id and status of wanted rows: already stored, failed, or to be indexed."""
    out = wanted.join(stored.select("id", F.lit(True).alias("_s")), "id", "left").join(failed.select("id", F.lit(True).alias("_f")), "id", "left")
    return out.select("id", F.when(F.col("_s"), "stored").when(F.col("_f"), "failed").otherwise("indexed").alias("status"))
