"""Recommendations and their evidence, name pivots, one-hop expansion, record projections, and what is carried on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedex.functions import labels
from remedex.functions import text as t

# Words of an instruction that name no compound.
NOT_A_COMPOUND = (
    "against", "between", "binding", "affinity", "library", "this", "that", "these", "those", "using", "via", "from", "into", "onto", "out", "over", "please", "also", "then",
    "next", "some", "any", "all", "both", "dock", "docking", "screen", "screening", "find", "show", "with", "for", "and", "the", "targets", "target",
)


def expanded(triples: DataFrame, node: str, limit: int = 60) -> DataFrame:
    """side, source, target: the links that leave a node, up to a limit, then those that reach it for what is left."""
    out = triples.where(F.col("source") == node).select(F.lit(0).alias("side"), "source", "target", F.col("target").alias("other")).distinct()
    back = triples.where(F.col("target") == node).select(F.lit(1).alias("side"), "source", "target", F.col("source").alias("other")).distinct()
    return out.unionByName(back).orderBy("side", "other").limit(limit).select("side", "source", "target")


def name_pivot(metadata: DataFrame, most: int = 100) -> DataFrame:
    """id, display of long metadata (id, attribute, value, line): the first full name, cut at a brace and to ``most``
    characters, else the first short name, gene name or the id; only ids of the species HUMAN."""
    first = lambda a: F.min_by("value", F.when(F.col("attribute") == a, F.col("line")))
    wide = metadata.groupBy("id").agg(*[F.when(F.bool_or(F.col("attribute") == a), first(a)).alias(a) for a in ("FULL_NAME", "SHORT_NAME", "NAME")], F.bool_or((F.col("attribute") == "SPECIES") & (F.col("value") == "HUMAN")).alias("human"))
    full = F.trim(F.substring(F.split("FULL_NAME", r"\{", 2)[0], 1, most))
    blank = lambda c: F.when(F.trim(c) != "", c)
    return wide.where("human").select("id", F.coalesce(blank(full), blank(F.col("SHORT_NAME")), blank(F.col("NAME")), "id").alias("display"))


def recommended(candidates: DataFrame) -> DataFrame:
    """session, action, candidates from candidates (session, id, known, confirmed, novelty, score).

    A confirmed hidden candidate that is under-explored is mined first; else, with a known one beside it, the user
    chooses; else it is mined; else the three best known ones go on; else there is nothing to do.
    """
    key = F.struct((-F.col("score")).alias("s"), "id")
    sure = ~F.col("known") & F.col("confirmed")
    best = lambda c: F.min(F.when(c, key))["id"]
    known = F.slice(F.array_sort(F.collect_list(F.when(F.col("known_rank") <= 3, key))), 1, 3)  # three rows at most
    rank = F.row_number().over(W.partitionBy("session", "known").orderBy(F.col("score").desc(), "id"))
    g = candidates.withColumn("known_rank", F.when(F.col("known"), rank)).groupBy("session").agg(best(sure & F.col("novelty").isin("High", "Moderate")).alias("open"), best(sure).alias("sure"), F.transform(known, lambda x: x["id"]).alias("known"))
    some = F.size("known") > 0
    action = F.when(F.col("open").isNotNull(), "literature_mining").when(F.col("sure").isNotNull() & some, "user_choice").when(F.col("sure").isNotNull(), "literature_mining").when(some, "drug_curation").otherwise("none")
    ids = F.when(F.col("open").isNotNull(), F.array("open")).when(F.col("sure").isNotNull() & some, F.array("sure", F.get("known", F.lit(0)))).when(F.col("sure").isNotNull(), F.array("sure")).otherwise(F.col("known"))
    return g.select("session", action.alias("action"), ids.alias("candidates"))


def mentions(haystack: Column, term: Column) -> Column:
    """Whether a text holds a term from the start of a word, whatever the case."""
    return F.regexp_like(F.lower(haystack), F.concat(F.lit(r"\b\Q"), F.lower(term), F.lit(r"\E")))


def evidence(articles: DataFrame, candidates: DataFrame, context: Sequence[str]) -> DataFrame:
    """name, articles, validated, strength of each candidate (name) of a short list.

    An article counts if it names the candidate and, if there are context terms, one of them.
    """
    text = F.coalesce("text", F.lit(""))
    near = reduce(lambda a, b: a | b, [mentions(text, F.lit(c)) for c in context], F.lit(not context))
    # A name and a text meet by the first letters of the name's first word; only then the whole name is looked for.
    names = candidates.select("name").distinct().withColumn("start", F.substring(F.regexp_extract(F.lower("name"), r"^\w*", 0), 1, 3))
    first = F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\w)\w{1,3}"), 0), F.array(F.lit(""))))
    short = lambda n: F.transform("first", lambda w: F.substring(w, 1, n))
    starts = F.array_distinct(F.concat("first", short(1), short(2)))
    seen = articles.select(text.alias("text"), near.alias("near"), first.alias("first")).select("text", "near", F.explode(starts).alias("start"))
    # The list is short, so it goes to the texts; dealt by start, each text would be written once for every start it has.
    hits = seen.join(F.broadcast(names), "start").where(mentions(F.col("text"), F.col("name")))
    n = hits.groupBy("name").agg(F.count("*").alias("articles"), F.count_if("near").alias("validated"))
    out = candidates.select("name").join(n, "name", "left").na.fill(0)
    return out.withColumn("strength", F.when(F.col("validated") > 0, "evidence-backed").otherwise("score-only"))


def leaders(scored: DataFrame, top: int = 3) -> DataFrame:
    """session, backed, headline: the best ``top`` candidates (session, name, score, backed) that evidence backs, or the best of all."""
    order = W.partitionBy("session", "backed").orderBy(F.col("score").desc(), "name")
    few = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
    any_ = F.max("backed").over(W.partitionBy("session"))
    # Where none is backed the rows are all of the one kind, so the ranks within the kind serve both cases.
    few = few.withColumn("any", any_).where(F.col("backed") == F.col("any"))
    one = F.struct("n", F.concat("name", F.lit(" ("), F.bround("score", 0).cast("bigint").cast("string"), F.lit("/100)")).alias("t"))
    return few.groupBy("session").agg(F.max("any").alias("backed"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), ", ").alias("headline"))  # ``top`` rows


def molecule_fields(m: Column) -> Column:
    """The criteria fields of a molecule record (full_mwt, alogp, orphan, withdrawn, reason, oral)."""
    flag = lambda c: F.when(c == 1, "yes").when(c == 0, "no")
    gone = F.coalesce(m["withdrawn"], F.lit(False))
    return F.struct(
        m["full_mwt"].try_cast("double").alias("molecular_weight"), m["alogp"].try_cast("double").alias("logp"), flag(m["orphan"]).alias("orphan_designation"),
        F.when(gone, "withdrawn").otherwise("not_withdrawn").alias("withdrawn_status"),
        F.when(gone, labels.withdrawal_reason(m["reason"])).otherwise("not_withdrawn").alias("withdrawal_reason"), flag(m["oral"]).alias("oral_administration"),
    )


def compounds(text: Column, target: Column, stop: Sequence[str] = NOT_A_COMPOUND) -> Column:
    """Compound names in an instruction: words of four characters or more that are no stop word, target or gene; the
    first spelling of each."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9-]{3,}"), 0)
    left = F.filter(words, lambda w: ~F.lower(w).isin(list(stop)) & (F.lower(w) != F.lower(F.coalesce(F.trim(target), F.lit("")))) & (w != F.upper(w)) & (F.coalesce(t.gene_symbol(w), F.lit("")) == ""))
    return F.filter(left, lambda w, i: F.array_position(F.transform(left, F.lower), F.lower(w)) == i + 1)


def by_reference(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, id: the first hit (id, rank, xrefs) that refers to each wanted id, whatever the case."""
    ref = hits.select("id", "rank", F.explode(F.array_distinct(F.transform("xrefs", F.upper))).alias("ref"))
    return wanted.select("wanted").join(ref, F.upper("wanted") == F.col("ref")).groupBy("wanted").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))


def split_report(text: Column, marker: str = "RECOMMENDED NEXT STEPS") -> Column:
    """answer and next of a report: cut before the first line that starts with the marker; all is answer without one."""
    body = F.coalesce(text, F.lit(""))
    head = F.regexp_extract(body, rf"(?ims)\A(.*?)(?:^\s*{marker}|\z)", 1)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.struct(strip(head).alias("answer"), strip(F.substring(body, F.length(head) + 1, F.length(body))).alias("next"))


def context_per_patent(chunks: DataFrame, top: int) -> DataFrame:
    """patent, used, ids: the best chunks (patent, id, score) of each patent, and how many there are."""
    rank = F.row_number().over(W.partitionBy("patent").orderBy(F.col("score").desc(), "id"))
    best = chunks.withColumn("n", rank).where(F.col("n") <= top)
    return best.groupBy("patent").agg(F.count("*").alias("used"), F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))  # ``top`` rows


def carried(targets: DataFrame, stages: dict[str, DataFrame], top: int = 3) -> DataFrame:
    """stage, id, found: the best targets (id, score), and whether each later stage (id) has a result; one that has none
    is recorded and stops nothing."""
    best = targets.orderBy(F.col("score").desc(), "id").limit(top).select("id")
    parts = [best.join(df.select("id", F.lit(True).alias("_f")).distinct(), "id", "left").select(F.lit(k).alias("stage"), "id", F.coalesce("_f", F.lit(False)).alias("found")) for k, df in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def with_neighbours(edges: DataFrame, ids: DataFrame, kind) -> DataFrame:
    """The ids (id) that an edge links to a node of a kind, as listed diseases need an edge in the graph."""
    near = edges.where(kind(F.col("dst"))).select(F.col("src").alias("id"))
    return ids.join(near, "id", "left_semi")


def wire_rows(nodes: DataFrame, known: DataFrame, unnamed) -> DataFrame:
    """nodeId, displayName, nodeType, indexed of nodes (id, name, kind) as they are sent: a node without a name shows what
    ``unnamed`` makes of its id, and is indexed if ``known`` (id) holds it."""
    held = known.select("id").distinct().withColumn("_k", F.lit(True))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), unnamed(F.col("id")))
    return nodes.join(held, "id", "left").select(F.col("id").alias("nodeId"), name.alias("displayName"), F.col("kind").alias("nodeType"), F.coalesce("_k", F.lit(False)).alias("indexed"))


def followed_up(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Questions (session, asked) about candidates, answered from the stored rows (session, id, name, category, score).

    Ids agree whatever their case. ``status`` says whether it was answered, is not among the session's candidates, or has no such
    session; nothing is computed again.
    """
    rows = stored.select("session", F.lower("id").alias("_k"), "id", "name", "category", "score")
    sessions = stored.select("session").distinct().withColumn("_s", F.lit(True))
    out = asked.withColumn("_k", F.lower("asked")).join(rows, ["session", "_k"], "left").join(sessions, "session", "left")
    status = F.when(F.col("id").isNotNull(), "answered").when(F.col("_s"), "not among the candidates").otherwise("no such session")
    why = F.when(F.col("category") == "known", ": a curated edge links them.").otherwise(": no curated edge links them, and its score clears the threshold.")
    text = F.concat("name", F.lit(" ("), "id", F.lit(") is labelled "), "category", why)
    return out.select("session", "asked", status.alias("status"), "id", "category", "score", text.alias("explanation"))


def needs_full_run(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests (session, disease) with ``full``: whether they need all steps, as their session is new or was about another disease."""
    last = sessions.select("session", F.lower(F.trim("disease")).alias("_d")).distinct()
    out = asked.join(last, "session", "left")
    return out.select("session", "disease", (~F.coalesce(F.col("_d") == F.lower(F.trim("disease")), F.lit(False))).alias("full"))


def row_id(*parts) -> Column:
    """A stable id of a row from the parts of its key."""
    return F.sha1(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def store_statistics(chunks: DataFrame, owner: str, cap: int) -> DataFrame:
    """chunks, patents, cap of a store of chunks; one row."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct(owner).alias("patents"), F.lit(cap).alias("cap"))


def name_table(parts: Sequence[DataFrame]) -> DataFrame:
    """id, name of several sources, each pair once; rows without a name are left out."""
    return reduce(DataFrame.unionByName, [p.select("id", "name") for p in parts]).where("name IS NOT NULL").distinct()


def approved_pairs(pairs: DataFrame, approved: DataFrame) -> DataFrame:
    """Pairs (drug, protein) of approved drugs (drug), each once."""
    return pairs.join(approved.select("drug"), "drug", "left_semi").select("drug", "protein").distinct()


def recommendation_trail(steps: DataFrame) -> DataFrame:
    """session, trail: the recommendations of a session's steps (session, step, recommendation) in order, blank ones left out."""
    own = steps.where(F.coalesce("recommendation", F.lit("")) != "")
    return own.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "recommendation"))), lambda x: x["recommendation"]).alias("trail"))
