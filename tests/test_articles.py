from pyspark.sql import functions as F

from remedex.sources import articles

XML = """<A><PMID>7</PMID><ArticleTitle> On x </ArticleTitle><Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract>
<PubDate><Year>2021</Year><Month>Feb</Month><Day>31</Day></PubDate><Author><LastName>Smith</LastName><Initials>J</Initials></Author>
<Author><LastName>Wu</LastName><Initials>K</Initials></Author><Keyword>Gene</Keyword><DescriptorName>gene</DescriptorName><DescriptorName>Cell</DescriptorName></A>"""


def test_record(spark):
    df = spark.createDataFrame([(XML,), ("<A><PMID>8</PMID></A>",), (None,)], "xml string")
    r, bare, none = articles.parsed(df).collect()
    assert (r.id, r.title, r.abstract, r.authors, str(r.published), r.keywords) == ("7", "On x", "One. Two.", "Smith, J. et al.", "2021-02-28", ["Gene", "Cell"])
    assert (bare.id, bare.title, bare.authors, bare.published, bare.keywords) == ("8", None, None, None, [])
    assert none.id is None


def test_sections(spark):
    df = spark.createDataFrame([({"title": "t", "abstract": "a"}, {"abstract": "b", "results": "r"}), ({"title": "t"}, None)], "a map<string,string>, f map<string,string>")
    got = [r[0] for r in df.select(articles.with_sections(F.col("a"), F.col("f"))).collect()]
    assert got == [{"title": "t", "abstract": "b", "results": "r"}, {"title": "t"}]
