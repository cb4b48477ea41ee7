import pytest
from pyspark.sql import functions as F

from remedex.sources import landed, patents, vendor
from remedex.sources.settle import new_folder

PAGE = """<meta name="DC.title" content="A &amp; B"><style>SUMMARY {}</style><!-- BACKGROUND --><div class="abstract">Abstract  of a thing</div>
<dd itemprop="assigneeOriginal">Old Co</dd><p>Field of the invention: things - </p>
<section class="claims"><div class="claims-head">Claims</div><div class="claim" num="2"><div>2. Like claim 1</div></div><div class="claim"><b>1)</b> A thing</div>
<div class="claim" num="2">2. Again</div><div class="claim" num="3"></div></section>"""


def records(spark, *html):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "id int, html string")
    return {r.id: r for r in patents.page_records(df).collect()}


def test_marked_page(spark):
    r = records(spark, PAGE)[0]
    assert (r.title, r.abstract, r.assignee, r.inventors, r.filing_date) == ("A & B", "of a thing", "Old Co", [], None)
    assert set(r.sections) == {"background"} and r.sections["background"].startswith("things")
    assert [(c.number, c.text, c.dependent, c.depends_on) for c in r.claims] == [(1, "A thing", False, []), (2, "Like claim 1", True, [1])]


def test_elements_within_each_other_and_all_references(spark):
    page = """<section itemprop="abstract"><section>Inner &#8364; &#x3b1;</section> outer &eacute;&hellip;</section><span itemprop="title">A<span>B</span> C</span>
    <dd itemprop="inventor">X <dd>Y</dd></dd><div class="abstract">not this</div><template>hidden</template>
    <section itemprop="claims"><section><div class="claim" num="00001"><div class="claim-text">1. A <div>deep</div> thing</div></div></section>
    <div class="claim-dependent"><div class="claim" num="00002"><div class="claim-text">2. As claim 1</div></div></div></section><div class="claim" num="9">outside</div>"""
    r = records(spark, page)[0]
    assert (r.title, r.abstract, r.inventors) == ("A B C", "Inner € α outer é…", ["X Y"])
    assert [(c.number, c.text, c.depends_on) for c in r.claims] == [(1, "A deep thing", []), (2, "As claim 1", [1])]
    open_ = records(spark, '<section itemprop="abstract"><p>one<p>two <b>three', '</div></p><span itemprop="title">T</i></span>')
    assert (open_[0].abstract, open_[1].title) == ("one two three", "T")


def test_pages_without_marks(spark):
    got = records(spark, None, "", "<p>no</p>", "<h2>Claims</h2>\n<p>1. One</p><p>2. As in claims 1 or 3</p><p>1. Other</p>", "x " * 30_000 + "SUMMARY " + "y" * 30_000)
    for i in range(3):
        assert (got[i].title, got[i].claims, got[i].sections) == (None, [], {})
    assert [(c.number, c.text, c.depends_on) for c in got[3].claims] == [(1, "One", []), (2, "As in claims 1 or 3", [1, 3])]
    assert got[4].sections == {"summary": "y" * patents.MOST}


def test_flat_entries(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', array(2, 3), 'y', CAST(NULL AS array<struct<z: int>>)) AS b UNION ALL SELECT NULL, NULL")
    assert [r.flat for r in landed.flat_entries(df).orderBy(F.col("a").desc()).collect()] == [{"a": "1", "b_x_0": "2", "b_x_1": "3"}, {"a": None}]


def test_declared_tables_that_wait_for_each_other(spark):
    with pytest.raises(ValueError, match="a"):
        landed.materialised(spark, new_folder(spark), {"a": lambda b: b, "b": lambda a: a})


def test_protein_links_without_publications(spark):
    rows = spark.createDataFrame([("uniprotkb:A", "uniprotkb:B", "doi:1"), ("uniprotkb:B", "uniprotkb:A", "pubmed:2|pubmed:1"), ("chebi:C", "uniprotkb:A", "pubmed:3")], "a string, b string, refs string")
    known = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "A")], "source string, target string")
    assert [tuple(r) for r in vendor.protein_links(rows, known).collect()] == [("B", "INTERACTS_WITH", "A", "1,2")]


def test_actions_both_ways(spark):
    rows = spark.createDataFrame([("c", "g", "increases^x|affects^x", "1|2"), ("c", "g", "decreases^x|decreases^y z", "3")], "chemical string, gene string, actions string, refs string")
    ids = [spark.createDataFrame([(a, a.upper())], f"{n} string, {m} string") for a, n, m in (("c", "chemical", "drug"), ("g", "gene", "protein"))]
    got = sorted(tuple(r) for r in vendor.chemical_actions(rows, *ids).collect())
    assert got == [("C", "AFFECTS_x", "G", "1,2"), ("C", "DECREASES_y_z", "G", "3")]


def test_costly_rows_are_dealt_to_all_tasks(spark, tmp_path):
    """A small table in one row group is one task; the entries and pages made of it are dealt to as many as shuffles have."""
    from remedex.plans import QUERIES, load_all

    load_all()
    part = spark.createDataFrame([(i, f"n{i}", "Brand#1", "T", 3) for i in range(1, 200)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("patent_page_records", "build_drug_tables", "build_protein_entries"):
        out = QUERIES[name](spark, str(tmp_path))
        assert out.rdd.getNumPartitions() == 4, name
