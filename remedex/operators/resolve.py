"""Matching of names: exact and normal forms by precedence, token subsets, contained phrases, fuzzy ratios, shortlists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.functions.text import plain_tokens
from remedex.sources.settle import settled


def normal_forms(name: Column) -> Column:
    """(rank, form) of a name: as it is, without commas, dashes as spaces, white space collapsed; all lower case."""
    low = F.lower(F.trim(name))
    bare = F.replace(low, F.lit(","), F.lit(""))
    spaced = F.replace(bare, F.lit("-"), F.lit(" "))
    flat = F.regexp_replace(spaced, r"\s+", " ")
    return F.array(*[F.struct(F.lit(i).alias("rank"), f.alias("form")) for i, f in enumerate((low, bare, spaced, flat))])


def resolved(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query, id, rank: the entity (id, name) whose form agrees with the earliest form of the query."""
    q = queries.select("query", F.inline(normal_forms(F.col("query"))))
    n = names.select("id", F.explode(F.array_distinct(F.transform(normal_forms(F.col("name")), lambda x: x["form"]))).alias("form"))
    hit = q.join(n, "form").groupBy("query").agg(F.min(F.struct("rank", "id")).alias("m"))
    return queries.select("query").join(hit, "query", "left").select("query", "m.id", "m.rank")


def last_by_form(names: DataFrame) -> DataFrame:
    """form, id: the entity (id, name, ord) that wrote each form last."""
    n = names.select("id", "ord", F.explode(F.array_distinct(F.transform(normal_forms(F.col("name")), lambda x: x["form"]))).alias("form"))
    return n.groupBy("form").agg(F.max_by("id", F.struct("ord", "id")).alias("id"))


def by_tokens(queries: DataFrame, names: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """query, id, coverage: the name that holds all tokens of the query, best covered first, then shorter, then by name.

    A name is found by the query's rarest token, so each query meets the names of one token only.
    """
    clean = lambda c: F.array_except(F.array_distinct(plain_tokens(c)), F.array(*map(F.lit, stop)).cast("array<string>"))
    n = names.select("id", "name", clean(F.col("name")).alias("nt"))
    keys = n.select(F.explode("nt").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    q = queries.select("query", clean(F.col("query")).alias("qt")).where(F.size("qt") > 0)
    rare = q.select("query", "qt", F.explode("qt").alias("token")).join(keys, "token").groupBy("query", "qt").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    pair = rare.join(n.select("*", F.explode("nt").alias("token")), "token").where(F.size(F.array_except("qt", "nt")) == 0)
    cover = F.size("qt") / F.size("nt")
    best = pair.groupBy("query").agg(F.min(F.struct((-cover).alias("c"), F.length("name").alias("l"), "name", "id")).alias("m"))
    return best.select("query", "m.id", (-F.col("m.c")).alias("coverage"))


def contained(texts: DataFrame, names: DataFrame, least: int = 5) -> DataFrame:
    """doc, id, name: the longest name of ``least`` characters or more that stands as whole words in each text.

    The words of a text meet the first words of names, with the lengths in words that these names have; the runs of those
    lengths from there are joined with the names on equality.
    """
    w = plain_tokens(F.col("name"))
    n = names.where((F.length("name") >= least) & (F.size(w) > 0)).select("id", "name", F.array_join(w, " ").alias("key"), F.size(w).alias("k"), F.element_at(w, 1).alias("first"))
    sizes = n.groupBy("first").agg(F.collect_set("k").alias("ks"))
    toks = texts.select("doc", plain_tokens(F.col("text")).alias("w"))
    starts = toks.select("doc", F.posexplode("w").alias("at", "first")).join(sizes, "first").groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("at", "ks")).alias("starts"))
    grams = F.flatten(F.transform("starts", lambda s: F.transform(s["ks"], lambda k: F.array_join(F.slice("w", s["at"] + 1, k), " "))))
    runs = toks.join(starts, F.col("doc").eqNullSafe(F.col("_doc"))).select("doc", F.explode(F.array_distinct(grams)).alias("key"))
    hit = runs.join(n, "key").groupBy("doc").agg(F.min(F.struct((-F.length("name")).alias("l"), "name", "id")).alias("m"))
    return hit.select("doc", "m.id", "m.name")


def labelled(text: Column, width: int = 1) -> Column:
    """The runs of ``width`` letters of a text, each with its occurrence number, so that a set of them is a multiset of runs."""
    n = F.length(text) - width + 1
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))
    # Equal runs stand together once sorted, and a run's number is its place behind the first of its kind.
    ordered = F.array_sort(runs)
    return F.transform(ordered, lambda x, i: F.concat(x, (i - F.array_position(ordered, x)).cast("string")))


def name_pairs(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """query, id, name: all pairs whose ratio may reach ``least``, and few others, found by an index of rare runs.

    Let t be the letters that must match, least * (a + b) / 2 for lengths a and b.  They lie in at most a + b - 2 t + 1 blocks, as
    between two blocks some letter is unmatched; so the texts share at least 3 t - a - b - 1 runs of two letters.  If that is
    positive, one of the rarest runs of each text is shared: of m runs of which k must be shared, one of any m - k + 1 is.  Else the
    same holds for single letters, of which t must be shared.  Pairs that meet are then held against the letters that both have.
    """
    q = queries.select("query", F.lower("query").alias("_k")).distinct().withColumn("a", F.length("_k"))
    n = names.select("id", "name", F.lower("name").alias("_k")).distinct().withColumn("b", F.length("_k"))
    runs = lambda df: df.withColumns({"one": labelled(F.col("_k")), "two": labelled(F.col("_k"), 2)})
    q, n = runs(q), runs(n)
    need = F.ceil(F.lit(least) * (F.col("a") + F.col("b")) / 2 - 1e-9).cast("int")
    bounds = [F.floor(F.col("a") * (least / (2 - least)) - 1e-9), F.ceil(F.col("a") * ((2 - least) / least) + 1e-9)]
    sizes = q.select("a").distinct().withColumn("b", F.explode(F.sequence(*bounds))).withColumn("t", need).withColumn("two", 3 * F.col("t") - F.col("a") - F.col("b") - 1)
    # How rare the runs are among all names decides which of a text's runs are looked up.
    counts = {k: n.select(F.explode(k).alias("run")).groupBy("run").agg(F.count("*").alias("c")) for k in ("one", "two")}

    def places(df: DataFrame, key: str, kind: str) -> DataFrame:
        """A row for each run of a text, with its place from the rarest on."""
        out = df.select(key, "_k", "one", F.size(kind).alias("m"), F.explode(kind).alias("run")).join(counts[kind], "run", "left")
        order = W.partitionBy(key).orderBy(F.coalesce("c", F.lit(0)), "run")
        return out.withColumn("at", F.row_number().over(order))

    found = []
    for kind in ("two", "one"):
        must = F.col("two") if kind == "two" else F.col("t")
        open_ = sizes.where("two > 0" if kind == "two" else "two <= 0").select("a", "b", must.alias("k"), "t")
        left = places(q, "query", kind).withColumn("a", F.length("_k")).join(open_, "a").where(F.col("at") <= F.col("m") - F.col("k") + 1)
        left = left.select("query", "run", "b", F.col("k"), "t", F.col("one").alias("qo"))
        right = places(n.withColumn("key", F.struct("id", "name")), "key", kind).withColumn("b", F.length("_k")).select("key", "run", "b", "at", F.col("m").alias("nm"), F.col("one").alias("no"))
        met = left.join(right, ["run", "b"]).where(F.col("at") <= F.col("nm") - F.col("k") + 1)
        met = met.where(F.size(F.array_intersect("qo", "no")) >= F.col("t"))
        found.append(met.select("query", "key.id", "key.name").distinct())
    nothing = q.where("a = 0").join(n.where("b = 0"), F.col("a") == F.col("b")).select("query", "id", "name")
    return found[0].unionByName(found[1]).unionByName(nothing)


def fuzzy(queries: DataFrame, names: DataFrame, least: float = 0.75, top: int = 5) -> DataFrame:
    """query, id, name, ratio, rank: the names most like each query by the ratio of matching blocks, from ``least`` on.

    Names are looked up at high ratios first; queries that have ``top`` names there need no lower one.
    """
    ladder = sorted({x for x in (0.75, 0.55) if x > least} | {least}, reverse=True)
    open_, found = queries.select("query").distinct(), None
    for i, step in enumerate(ladder):
        got = _ratios(name_pairs(open_, names, step), step)
        if i < len(ladder) - 1:
            got = settled(got)
            full = got.groupBy("query").count().where(F.col("count") >= top)
            done, open_ = got.join(full, "query", "left_semi"), settled(open_.join(full, "query", "left_anti"))
        else:
            done = got
        found = done if found is None else found.unionByName(done)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("ratio").desc(), "name", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def _ratios(pairs: DataFrame, least: float) -> DataFrame:
    def ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for b in batches:
            yield b.assign(ratio=pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(b["query"], b["name"], strict=True)], index=b.index, dtype="float64"))

    return pairs.mapInPandas(ratio, "query string, id long, name string, ratio double").where(F.col("ratio") >= least)


def shortlist(requests: DataFrame, structures: DataFrame, most: int = 5) -> DataFrame:
    """name, status, choices: one structure (name, id, experimental) resolves a request, several are a shortlist of the
    first, none leaves it open; predicted structures count only where there is no experimental one."""
    hit = requests.select("name").distinct().join(structures, "name", "left")
    any_ = F.max("experimental").over(W.partitionBy("name"))
    kept = hit.withColumn("_e", any_).where(F.col("id").isNull() | (F.col("experimental") == F.col("_e")))
    rank = F.row_number().over(W.partitionBy("name").orderBy("id"))
    kept = kept.withColumns({"_n": rank, "_all": F.count("id").over(W.partitionBy("name"))}).where(F.col("_n") <= most)
    status = F.when(F.max("_all") == 0, "unresolved").when(F.max("_all") == 1, "resolved").otherwise("ambiguous")
    return kept.groupBy("name").agg(status.alias("status"), F.max("_all").alias("matches"), F.array_sort(F.collect_list("id")).alias("choices"))


def ranked_hits(hits: DataFrame, query: str, ontology: str = "MONDO") -> DataFrame:
    """Hits (id, name) of a query: equal names first, then the preferred ontology, names that hold it, fewer words."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", " ")
    q = norm(F.lit(query))
    return hits.orderBy(norm(F.col("name")) != q, ~F.col("id").startswith(ontology), ~F.contains(norm(F.col("name")), q), F.size(F.split("name", " ")), "id")
