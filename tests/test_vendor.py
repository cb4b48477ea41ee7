from pyspark.sql import functions as F

from remedex.sources import vendor


def test_flat_records(spark, tmp_path):
    (tmp_path / "a.dat").write_text("ID   P1 x\nDR   GO:1; GO:2;\nCC   other\n//\nID   P2\nDR   GO:1;\n//\n")
    got = vendor.record_triples(vendor.read_records(spark, f"{tmp_path}/a.dat"), {"DR": "XREF"}).collect()
    assert sorted(map(tuple, got)) == [("P1", "XREF", "GO:1"), ("P1", "XREF", "GO:2"), ("P2", "XREF", "GO:1")]


def test_links_and_turns(spark):
    df = spark.createDataFrame([("hsa:1", "path:2"), ("hsa:1", "zz:3"), ("hsa:1", "path:2")], "a string, b string")
    t = vendor.link_triples(df, "a", "b", {("hsa", "path"): "GENE_PATHWAY"})
    assert [tuple(r) for r in t.collect()] == [("1", "GENE_PATHWAY", "2")]
    assert [tuple(r) for r in vendor.turned(t, F.col("edge_type") == "GENE_PATHWAY").collect()] == [("2", "GENE_PATHWAY", "1")]
    assert [r[0] for r in vendor.piped(spark.createDataFrame([("a| b||",)], "x string"), "x").collect()] == ["a", "b"]


def test_preamble(spark):
    lines = [("f", 0, "about"), ("f", 1, "GENE\tSITE\tORG"), ("f", 2, "A\tS1\thuman"), ("g", 0, "ORG\tx\tGENE"), ("g", 1, "mouse\t1\tB")]
    df = spark.createDataFrame(lines, "file string, line int, value string")
    assert sorted(map(tuple, vendor.after_header(df, ["GENE", "ORG"]).collect())) == [("A", "human"), ("B", "mouse")]


def test_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><e><n>x</n></e><e><n>y</n></e></all>")
    assert sorted(r.n for r in vendor.read_entries(spark, f"{tmp_path}/a.xml", "e", "n string").collect()) == ["x", "y"]
