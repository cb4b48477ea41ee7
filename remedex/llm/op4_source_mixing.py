"""Mixing sources to target weights by blocks.

The words of each source, in a fixed pseudorandom order of its documents, are packed into blocks of a fixed length.
Output shards of fixed size draw their source counts from a multinomial with the target shares; the slots of a source
are numbered over the shards, and a slot's number is mapped through the source's pseudorandom permutation of its block
indices, anew for each pass over the source.  Slots and blocks are joined by index.  As the draws of many shards miss
the totals by chance, slots beyond a source's quota are handed to sources below theirs.

Every slot keeps the number of its shard; the slots that are handed over lie in further shards of their own.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating; a target stops at three times its source's size
and the excess is shared again by weight until none is above.  A quota never passes three times the source's blocks, so
no document is taken more than three times.

Word positions within a source come from two prefix sums: within (source, bucket), and over the bucket totals, so a
source that holds a third of all rows is dealt over many tasks.  The draws are made by shard number alone, so reruns
agree.

Defined cases: a null text has size 0 and nothing taken; a null source is a source of its own; repeated rows are packed
one after the other; a null doc_id is an id like others; an empty table gives no rows; other columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedex.llm.common import Scratch, mix as scramble, small_batches, table, words

NAME = "op4_source_mixing"
BLOCK, SHARD, MOST, SEED = 64, 4096, 3, 20240229
SLOTS_PER_TASK = 1 << 16
WEIGHTS = (1, 2, 3)
ROWS_PER_BUCKET = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target from one row per source.  The number of rounds is at most that of sources."""
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    # A source reaches its cap in the order of cap / weight, so one running sum over that order settles all rounds:
    # with the sources before it at their caps, a source is capped if its share of the rest is above its cap.
    cap = F.col("source_size") * float(most)
    by = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    out = out.withColumns({"_left": F.sum("source_size").over(everyone) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)), "_weight": F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    share = F.col("weight") * F.col("_left") / F.col("_weight")
    out = out.withColumns({"_share": share / F.col("weight"), "_capped": share > cap})
    # The level of the first source that is not capped is that of all after it.
    level = F.first(F.when(~F.col("_capped"), F.col("_share")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("target", F.when(level.isNull(), cap).otherwise(F.least(F.col("weight") * level, cap))).drop("_left", "_weight", "_share", "_capped")


def _keys() -> list[int]:
    return [int(x) for x in np.random.default_rng(SEED).integers(1, 1 << 62, 4)]


def permuted(k: np.ndarray, n: int, source: int, turn: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at k: four Feistel rounds, walked until the value is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64((x + source * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1)) for x in _keys()]
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for x in keys:
            a, b = b, a ^ (scramble(b + x) & low)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draws(shard: int, slots: int, shares: np.ndarray) -> np.ndarray:
    """Multinomial source counts of a shard."""
    return np.random.default_rng((SEED, shard)).multinomial(slots, shares)


def positions(docs: DataFrame, rows: int) -> DataFrame:
    """Adds ``first``: the number of the source's words before the document, by two prefix sums."""
    n = max(1, rows // ROWS_PER_BUCKET + 1)
    out = docs.withColumn("_b", F.pmod(F.xxhash64(F.coalesce("doc_id", "tie")), F.lit(n)))
    sums = out.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = W.partitionBy("source", "_b").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0))).alias("d")
    at = sums.alias("s")
    joined = out.join(at, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._b") == F.col("s._b")))
    return joined.select("d.*", (F.col("_own") + F.col("_before")).alias("first")).drop("_b", "_own")


def block_counts(spark: SparkSession, plan: pd.DataFrame, block: int = BLOCK) -> DataFrame:
    """shard, number (of the source), block, turn: one row for each slot of the mix.  ``plan`` has a row for each source."""
    size, target = plan["source_size"].to_numpy(float), plan["target"].to_numpy(float)
    blocks = -(-plan["source_size"].to_numpy(np.int64) // block)
    quota = np.minimum(np.rint(np.divide(target * blocks, size, out=np.zeros_like(size), where=size > 0)).astype(np.int64), MOST * blocks)
    total = int(quota.sum())
    shards = -(-total // SHARD)
    if not total:
        return spark.createDataFrame([], "shard long, number int, block long, turn int")
    shares = quota / total

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                slots = min(SHARD, total - shard * SHARD)
                yield pd.DataFrame({"shard": shard, "number": np.arange(len(shares), dtype=np.int32), "n": draws(shard, slots, shares)})

    counts = spark.range(shards).mapInPandas(count, "shard long, number int, n long")
    # Slots of a source before each shard; two prefix sums, so no task sees all shards of a source.
    counts = counts.withColumn("g", F.expr("shard div 1024"))
    groups = counts.groupBy("number", "g").agg(F.sum("n").alias("gn"))
    groups = groups.withColumn("gb", F.coalesce(F.sum("gn").over(W.partitionBy("number").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("gn")
    own = W.partitionBy("number", "g").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("sb", F.coalesce(F.sum("n").over(own), F.lit(0))).join(groups, ["number", "g"])
    counts = counts.select("shard", "number", "n", (F.col("sb") + F.col("gb")).alias("start"))
    quotas = quota.tolist()
    limit = F.element_at(F.array(*map(F.lit, quotas)), F.col("number") + 1)
    kept = counts.withColumn("n", F.greatest(F.lit(0), F.least(F.col("n"), limit - F.col("start")))).where("n > 0").select("shard", "number", "start", "n")
    # What a source was drawn too few times it gets from the slots that others were drawn too often.
    drawn = kept.groupBy("number").agg(F.sum("n").alias("have"))
    every = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quotas)], "number int, quota long")
    short = every.join(drawn, "number", "left").select("number", F.coalesce("have", F.lit(0)).alias("start"), (F.col("quota") - F.coalesce("have", F.lit(0))).alias("n")).where("n > 0")
    pieces = short.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {SHARD}"))))
    own = F.lit(shards) + F.col("piece") * len(quotas) + F.col("number")
    pieces = pieces.select(own.cast("bigint").alias("shard"), "number", (F.col("start") + F.col("piece") * SHARD).alias("start"), F.least(F.lit(SHARD), F.col("n") - F.col("piece") * SHARD).alias("n"))
    blocks_of = blocks.tolist()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, number, start, n in zip(b["shard"], b["number"], b["start"], b["n"], strict=True):
                k, have = np.arange(start, start + n), blocks_of[number]
                turn = k // have
                at = np.empty(n, dtype=np.int64)
                for t in np.unique(turn):
                    m = turn == t
                    at[m] = permuted(k[m] - t * have, have, number, int(t))
                yield pd.DataFrame({"shard": np.full(n, shard, np.int64), "number": np.full(n, number, np.int32), "block": at, "turn": turn.astype(np.int32)})

    # The ranges of slots are small rows that grow in the map, so they are dealt by the number of slots.
    ranges = kept.unionByName(pieces).repartition(total // SLOTS_PER_TASK + 1, "shard", "number")
    return ranges.mapInPandas(place, "shard long, number int, block long, turn int")


def mix(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Per document (row, doc_id, source, size, source_size, target, number, first, tie), and the slots of the mix.

    The sources are few and their table has one row each, so it is read by the driver to plan the quotas.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    sized = scratch.put(sized, "sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))).toPandas()
    plan = plan.sort_values("source", key=lambda s: s.map(lambda x: (x is None, (x or "").encode())), ignore_index=True)
    plan["number"] = np.arange(len(plan), dtype=np.int32)
    facts = [(s if isinstance(s, str) else None, int(z), float(t), int(k)) for s, z, t, k in zip(plan["source"], plan["source_size"], plan["target"], plan["number"], strict=True)]
    facts = spark.createDataFrame(facts, "s string, source_size long, target double, number int")
    placed = positions(sized, int(plan["rows"].sum() if len(plan) else 0))
    placed = placed.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # one row for each source, as read above
    return placed, block_counts(spark, plan, block)


def shard_sizes(slots: DataFrame) -> DataFrame:
    """shard, number, n: the slots of each source in each output shard."""
    return slots.groupBy("shard", "number").agg(F.count("*").alias("n"))


def parts(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks that each document lies in, with the part of it there: ``at`` (its words before) and ``n``."""
    last = F.expr(f"(first + size - 1) div {block}")
    out = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), last)))
    start = F.greatest(F.lit(0), F.col("block") * block - F.col("first"))
    return out.withColumns({"at": start, "n": F.least(F.col("size"), (F.col("block") + 1) * block - F.col("first")) - start})


def _dealt(slots: DataFrame) -> DataFrame:
    """The slots as a side that is never broadcast: their shuffled bytes compress to few, while the driver would hold a row for each of them."""
    return slots.hint("merge")


def taken(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    times = slots.groupBy("number", "block").agg(F.count("*").alias("times"))
    got = parts(placed, block).select("row", "number", "block", "n").join(_dealt(times), ["number", "block"])
    got = got.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    out = placed.join(got, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """The mix as documents: for each pass over a source, the document's words in the blocks taken in that pass.

    A document taken whole keeps its text as it is; adjacent parts stay joined by their own white space.
    """
    placed, slots = mix(docs, scratch, block)
    runs = parts(placed, block).select("row", "doc_id", "tie", "number", "block", "at", "n").join(_dealt(slots.drop("shard")), ["number", "block"])
    runs = runs.groupBy("row", "doc_id", "tie", "turn").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("_parts"))  # at most size / block + 2 parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_pick(t, p) for t, p in zip(b.column("_text").to_pylist(), b.column("_parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string())], ["_row", "_text"])

    small_batches(docs.sparkSession)
    # The document's columns are held in one, so their names do not matter. Repeated rows have the same text, so any of them
    # may stand for each of the places.
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    one = rows.groupBy("_id", "_tie").agg(F.first("_row").alias("_row"))
    met = one.join(runs, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie"))).select("_row", F.col("_row.text").cast("string").alias("_text"), "_parts")
    made = met.mapInArrow(cut, T.StructType([met.schema["_row"], T.StructField("_text", T.StringType())]))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return made.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def _pick(text: str, spans) -> str:
    import re

    bounds = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    joined: list[list[int]] = []
    for s in spans:
        if joined and joined[-1][1] == s["at"]:
            joined[-1][1] += s["n"]
        else:
            joined.append([s["at"], s["at"] + s["n"]])
    if joined == [[0, len(bounds)]]:
        return text
    return "\n".join(text[bounds[a][0] : bounds[b - 1][1]] for a, b in joined)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    placed, slots = mix(table(spark, sf_dir, "documents"), scratch)
    return taken(placed, slots)
