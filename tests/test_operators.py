import math

import pytest
from pyspark.sql import functions as F

from remedex.functions import labels, text
from remedex.operators import app, compile, graph, literature, profile, resolve, retrieval, screening
from remedex.sources import triples


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


# ---------------------------------------------------------------- functions


def test_label_fields(spark):
    t = F.lit("Tablets. Take twice daily. The half-life is 30 to 60 minutes. Bioavailability of 45% via CYP2D6 and CYP2C9.")
    got = one(spark, labels.dosage_form(F.lit("one tablet")), labels.dosing_frequency(t), labels.bioavailability(t), labels.half_life_hours(t), labels.cyp_bucket(t))
    assert got == ("oral_solid", "twice_daily", 45.0, 0.75, "multiple")
    assert one(spark, labels.dosage_form(F.lit("none such")), labels.cyp_bucket(F.lit("x"))) == (None, None)


def test_bands_and_reasons(spark):
    got = one(spark, *[labels.novelty_band(F.lit(x).cast("long")) for x in (None, 0, 10, 50, 51)])
    assert got == ("Unknown", "High", "Moderate", "Low", "Well-explored")
    assert one(spark, labels.withdrawal_reason(F.lit("Commercial; safety")), labels.withdrawal_reason(F.lit(None).cast("string"))) == ("commercial", "unknown")
    assert one(spark, labels.clinical_phase(F.lit("Phase 2/Phase 3")), labels.squashed(F.lit(260.0))) == (2.5, pytest.approx(72.222222, abs=1e-5))


def test_small_molecules(spark):
    got = [one(spark, labels.removal_reason(F.lit(n), F.lit(s), F.lit(w).cast("string")))[0] for n, s, w in (("aspirin", "C", 180), ("adalimumab", "C", 1), ("x", " ", 1), ("insulin glargine", "C", 1), ("y", "C", 1300), ("ase", "C", None))]
    assert got == [None, "biologic, not a small molecule", "no defined chemical structure", "biologic, not a small molecule", "molecular weight above the small-molecule range", None]


def test_sentences_and_relations(spark):
    s = F.lit("JAK2 activates STAT3 [12]. It plays a key role in growth. (Smith et al. 2019) agree? no.")
    assert one(spark, F.size(text.sentences(s)))[0] == 3
    p = text.relation_phrase(F.lit("it Plays a  key role in growth and targets x"))
    assert one(spark, p)[0] == "plays a key role in"
    for t, want in (("shown [12]", True), ("shown (Smith et al. 2019)", True), ("plain words", False)):
        assert one(spark, text.is_cited(F.lit(t), F.lit(0), F.lit(0)))[0] is want
    far = "activates " + "x" * 200 + " [12]"
    assert one(spark, text.is_cited(F.lit(far), F.lit(1), F.lit(9)))[0] is False


def test_patent_texts(spark):
    assert one(spark, text.patent_id(F.lit("US10,123,456 B2")))[0] == "US10123456B2"
    assert one(spark, text.patent_id(F.lit("https://patents.google.com/patent/us2024123456a1/en?q=1")))[0] == "US2024123456A1/EN"
    assert one(spark, text.canonical_patent_id(F.lit("US2024123456A1")))[0] == "US20240123456A1"
    assert one(spark, text.claims_named(F.lit("as in claims 1 to 3, or claim 7")))[0] == [1, 3, 7]
    assert one(spark, text.hyphen_tokens(F.lit("Anti-body x")))[0] == ["anti-body", "anti", "body", "x"]
    got = one(spark, *[text.looks_like_title(F.lit(q)) for q in ('"a"', "what is a Kinase here", "Kinase inhibitor for cancer", "low case words only here")])
    assert got == (True, False, True, False)


def test_queries(spark):
    assert one(spark, text.gene_symbol(F.lit("THE role of JAK2 in x")))[0] == "JAK2"
    assert tuple(one(spark, text.target_and_disease(F.lit("JAK2 in myelofibrosis for x")))[0]) == ("JAK2", "myelofibrosis for x")
    assert one(spark, text.without_noise(F.lit("@graph find targets for asthma."), ["find targets", "for"]))[0] == "asthma"
    assert one(spark, text.numbered_reply(F.lit("1. a\n2) b\n9. c\n2. d"), 3))[0] == {1: "a", 2: "d"}
    assert one(spark, text.trimmed_to_sentence(F.lit("A full one. Another. And a bro")))[0] == "A full one. Another."


def test_types_and_names(spark):
    ids = ("DB00001", "MESH:D001249", "123456", "GO:0001", "R-HSA-1-2", "hsa04110", "P01375", "what")
    got = one(spark, *[labels.entity_type(F.lit(i)) for i in ids])
    assert got == ("drug", "disease", "genetic_disorder", "biological_process", "complex", "pathway", "gene/protein", "other")
    assert one(spark, labels.search_aliases(F.lit("P1"), F.lit("UniProt:P1"), F.lit("TNF"), F.lit("TNF"), F.lit(None)))[0] == ["TNF"]
    assert one(spark, labels.repaired_url(F.lit("example.com//a b")))[0] == "https://example.com/ab"


# ---------------------------------------------------------------- graph

KIND = lambda c: F.substring(c, 1, 1)
REGISTRY = {"x": 0.9, "y": 0.5}


@pytest.fixture
def small(spark):
    rows = [("D1", "x", "P1"), ("P1", "x", "P2"), ("P2", "y", "P3"), ("D1", "x", "D1"), ("P1", "x", "D1"), ("W1", "x", "P3"), ("P1", "x", "W1")]
    return graph.symmetric(spark.createDataFrame(rows, "source string, edge_type string, target string"))


def test_edges_are_symmetric_without_loops(small):
    got = {(r.src, r.dst) for r in small.collect()}
    assert got == {(b, a) for a, b in got}
    assert len(got) == 10
    assert all(a != b for a, b in got)


def test_weights_of_a_node_add_up_to_one(small):
    got = graph.layered_weights(small, KIND).groupBy("src").agg(F.sum("w").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-12 for r in got)


def test_walk_keeps_the_mass(spark, small):
    seeds = spark.createDataFrame([("D1", 1.0)], "id string, p double")
    p = {r.id: r.p for r in graph.walk(graph.layered_weights(small, KIND), seeds, 8).collect()}
    assert abs(sum(p.values()) - 1) < 1e-12
    assert max(p, key=p.get) == "D1"


def test_hypergeometric_tail(spark):
    got = one(spark, graph.hypergeometric_tail(F.lit(3), F.lit(10), F.lit(20), F.lit(200)), graph.hypergeometric_tail(F.lit(0), F.lit(10), F.lit(20), F.lit(200)))
    want = sum(math.comb(20, i) * math.comb(180, 10 - i) for i in range(3, 11)) / math.comb(200, 10)
    assert got[0] == pytest.approx(want, rel=1e-9)
    assert got[1] == 1.0


def test_paths_are_simple_and_gated(spark, small):
    goal = spark.createDataFrame([("P3",)], "id string")
    found = graph.describe(graph.paths(small, "D1", goal, lambda c: KIND(c) != "D"), REGISTRY)
    got = {tuple(r.nodes): r.min_confidence for r in found.collect()}
    assert got == {("D1", "P1", "P2", "P3"): 0.5, ("D1", "P1", "W1", "P3"): 0.9}
    gate = graph.gate(found).first()
    assert (gate.confirmed, gate.n_paths, gate.hops) == (True, 2, 3)
    assert [r["rank"] for r in graph.best_paths(found, 1).collect()] == [1]


def test_tree_has_one_parent_a_node(small):
    got = graph.capped_bfs(small, "D1", {"D": 9, "P": 1}, lambda c: F.lit(1), KIND, 3).collect()
    assert len({r.id for r in got}) == len(got)
    assert {(r.id, r.hop) for r in got} >= {("D1", 0), ("P1", 1)}


# ---------------------------------------------------------------- profiles


def test_scores_of_the_fixture(spark):
    rows = [(1, 0.2, 0.0, "yes"), (2, 0.5, 1.0, None), (3, 0.8, 2.0, "no")]
    v = profile.long_form(spark.createDataFrame(rows, "id long, qed double, half double, box string"), "id", ["qed", "half"], ["box"])
    b = profile.baselines(v)
    stats = {r.criterion: r for r in b.collect()}
    assert (stats["qed"].n, stats["qed"].median, stats["box"].n, stats["box"].kinds) == (3, 0.5, 2, 2)
    crit = spark.createDataFrame([("qed", 3, False, {}), ("half", 1, True, {}), ("box", 1, False, {"yes": 0.0, "no": 1.0})], "criterion string, weight int, lower boolean, scores map<string,double>")
    got = {r.id: r for r in profile.composite(profile.normalised(v, b, crit)).collect()}
    assert got[1].score == pytest.approx(20.0)
    assert got[3].score == pytest.approx(80.0)
    assert got[2].missing == ["box"]
    assert got[2].completeness == pytest.approx(0.8)


def test_flat_baseline_is_an_exact_match(spark):
    v = profile.long_form(spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0), (4, 4.0)], "id long, logp double"), "id", ["logp"], [])
    base = profile.baselines(v.where("id < 3"))
    crit = spark.createDataFrame([("logp", 1, False, {})], "criterion string, weight int, lower boolean, scores map<string,double>")
    got = {r.id: r.norm for r in profile.normalised(v, base, crit).collect()}
    assert (got[3], got[4]) == (1.0, 0.0)


def test_effective_weights_add_up(spark):
    w = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3), ("d", 9, 4)], "criterion string, weight int, ord int")
    got = {r.criterion: r.weight for r in profile.effective_weights(w, F.col("criterion") == "d").collect()}
    assert got == {"a": 34, "b": 33, "c": 33}


def test_merge_keeps_the_first_value_but_prefers_a_source(spark):
    rows = [("s1", "K", None, 1.0, 0), ("s2", "K", "x", 2.0, 1), ("ot", "K", "y", 3.0, 2)]
    df = spark.createDataFrame(rows, "source string, k string, name string, phase double, p int")
    r = profile.merged_records(df, F.col("k"), F.col("p"), ["name", "phase"], preferred=["phase"], prefer="ot").first()
    assert (r.name, r.phase, r.records, r.sources) == ("x", 3.0, 3, ["ot", "s1", "s2"])


# ---------------------------------------------------------------- literature, retrieval, names


def test_evidence_scores(spark):
    rows = [(1, "r", False, 1.0, 0.5), (2, "r", True, 0.3, 0.5), (3, None, False, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "id long, relation string, cited boolean, weight double, similarity double")
    got = {r.id: r.score for r in literature.evidence_scores(df).collect()}
    assert got == {1: pytest.approx(90.0), 2: pytest.approx(57.5), 3: pytest.approx(12.5)}


def test_fusion_and_bm25(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("B", 1), ("A", 3)], "id string, rank int")
    assert [r.id for r in retrieval.ranked(retrieval.fused(df), 5).collect()] == ["B", "A"]
    docs = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["c"]), (4, [])]
    got = {r.id: r.score for r in retrieval.bm25(spark.createDataFrame(docs, "id long, tokens array<string>"), ["a", "b", "zz"]).collect()}
    n, avg = 4, 6 / 4
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in {"a": 1, "b": 2, "c": 2}.items()}
    mean = sum(idf.values()) / 3
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in idf.items()}
    for i, tk in docs:
        want = sum(idf[q] * tk.count(q) * 2.5 / (tk.count(q) + 1.5 * (0.25 + 0.75 * len(tk) / avg)) for q in ("a", "b"))
        assert got[i] == pytest.approx(want)


def test_chunks_stop_at_the_end(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(901)))), (2, "a b"), (3, ""), (4, " ".join(map(str, range(900))))], "id long, t string")
    got = sorted((r.id, r.chunk_index, len(r.chunk_text.split())) for r in retrieval.chunks(df, F.col("t")).collect())
    assert got == [(1, 0, 500), (1, 1, 500), (1, 2, 101), (2, 0, 2), (4, 0, 500), (4, 1, 500)]


def test_names(spark):
    names = spark.createDataFrame([(1, "Diabetes Mellitus, Type 2"), (2, "Asthma"), (3, "lung neoplasms")], "id long, name string")
    q = spark.createDataFrame([("diabetes mellitus type 2",), ("ASTHMA",), ("none",)], "query string")
    assert {r.query: r.id for r in resolve.resolved(q, names).collect()} == {"diabetes mellitus type 2": 1, "ASTHMA": 2, "none": None}
    fuzzy = resolve.fuzzy(spark.createDataFrame([("asthmaa",)], "query string"), names).collect()
    assert [(r.id, r["rank"]) for r in fuzzy] == [(2, 1)]
    s = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, False), ("b", 4, False)], "name string, id long, experimental boolean")
    r = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert {x.name: (x.status, x.choices) for x in resolve.shortlist(r, s).collect()} == {"a": ("resolved", [1]), "b": ("ambiguous", [3, 4]), "c": ("unresolved", [])}


# ---------------------------------------------------------------- screening, compiling, application


def test_docking_logs(spark):
    lines = ["mode | affinity", "-----+-----", "   1   -9.234   0.0  0.0", "   2   -8.1  1 2", " 3 -7.05 1 1", "done"]
    got = [(r.mode, r.affinity) for r in screening.log_rows(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [(1, -9.234), (2, -8.1), (3, -7.05)]
    rows = spark.createDataFrame([("A", -7.0, 1), ("A", -5.0, 2), ("B", -9.5, 1)], "ligand string, affinity double, mode int")
    best = screening.best_poses(rows, ["ligand"], "affinity", ["mode"])
    assert [(r.ligand, r.affinity) for r in screening.top_fraction(best, "affinity", ["ligand"], 0.5).collect()] == [("B", -9.5)]


def test_batch_is_refused_when_too_large(spark):
    with pytest.raises(ValueError, match="combinations"):
        screening.batch(spark.range(30), spark.range(30).withColumnRenamed("id", "d"))


def test_prefixes_and_effects(spark):
    assert one(spark, compile.tree_prefixes(F.lit("C01.2.33")))[0] == ["C01", "C01.2", "C01.2.33"]
    assert one(spark, compile.code_levels(F.lit("A10BA02")))[0] == ["A", "A10", "A10B", "A10BA", "A10BA02"]
    got = one(spark, compile.interaction_effects(F.lit("X may increase the hypoglycemic activities of Y.")))[0]
    assert got == ["increase_hypoglycemia"]
    assert one(spark, compile.interaction_effects(F.lit("nothing")))[0] == []
    assert str(one(spark, compile.clamped_date(F.lit(2023), F.lit("February"), F.lit("31")))[0]) == "2023-02-28"


def test_upsert_and_states(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    s = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, o int")
    got = triples.upsert(t, s, ["k"], F.col("o")).select("k", "v").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "x"), (3, "z")]
    log = spark.createDataFrame([(1, "queued", 1), (1, "running", 1), (2, "queued", 1), (2, "completed", 5)], "job long, status string, ts long")
    assert {r.job: r.status for r in app.job_states(log).collect()} == {1: "running", 2: "completed"}
    assert {r.job: r.status for r in app.job_states(log, F.col("ts") < 3).collect()} == {1: "failed", 2: "completed"}


def test_sinks_and_scans(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tattribute\tvalue\nP1\tNAME\tx\n")
    assert [tuple(r) for r in triples.read_metadata(spark, str(tmp_path / "t.tsv")).collect()] == [("P1", "NAME", "x")]
    df = spark.createDataFrame([(1, ["a"])], "k long, v array<string>")
    triples.append_rows(df, f"{tmp_path}/gold", "j1")
    triples.append_rows(df.withColumn("w", F.lit(2)), f"{tmp_path}/gold", "j2")
    got = triples.read_job(spark, f"{tmp_path}/gold", "j2").first()
    assert (got.k, got.v, got.w) == (1, '["a"]', 2)
    assert triples.id_and_name(["score", "Accession", "symbol"]) == ("Accession", "symbol")


def test_recommendation_rules(spark):
    from remedex.operators import advice

    rows = [("a", 1, False, True, "High", 1.0), ("a", 2, True, True, "Low", 9.0), ("b", 3, False, True, "Low", 5.0), ("b", 4, True, True, "Low", 1.0), ("c", 5, False, True, "Unknown", 1.0), ("d", 6, True, False, "Low", 1.0), ("d", 7, True, False, "Low", 3.0), ("e", 8, False, False, "High", 1.0)]
    got = {r.session: (r.action, r.candidates) for r in advice.recommended(spark.createDataFrame(rows, "session string, id long, known boolean, confirmed boolean, novelty string, score double")).collect()}
    assert got == {"a": ("literature_mining", [1]), "b": ("user_choice", [3, 4]), "c": ("literature_mining", [5]), "d": ("drug_curation", [7, 6]), "e": ("none", [])}


def test_suggestions_equal_a_plain_search(spark):
    from difflib import SequenceMatcher

    from remedex.operators import resolve

    names = [(i, n) for i, n in enumerate(["asthma", "acne", "gout", "goat", "croup", "myopia", "anaemia", "x", ""])]
    got = resolve.fuzzy(spark.createDataFrame([("ashtma",), ("gaot",)], "query string"), spark.createDataFrame(names, "id long, name string"), least=0.3, top=5).collect()
    for q in ("ashtma", "gaot"):
        like = sorted(((-SequenceMatcher(None, q, n).ratio(), n) for _, n in names if SequenceMatcher(None, q, n).ratio() >= 0.3))[:5]
        assert [r.name for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == [n for _, n in like]
