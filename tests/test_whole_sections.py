"""Sections of patent pages are read to their end."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from remedex.sources import patents


def test_query_keeps_whole_sections(spark, write_table):
    name, kind = "n " * 20_000 + "end", "t" * 45_000 + " last"
    d = write_table("part", [(1, name, "Brand#1", kind, 3), (2, "short", "Brand#2", "T", 4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    got = {r.p_partkey: (r.background, r.summary) for r in entry.queries()["patent_page_records"](spark, d).collect()}
    assert got == {1: ("Old " + name, "New " + kind), 2: ("Old short", "New T")}


def test_sections_are_whole_unless_bounded(spark):
    df = spark.createDataFrame([("SUMMARY " + "é" * 50_000,)], "t string")
    assert df.select(patents.sections(F.col("t"))).first()[0] == {"summary": "é" * 50_000}
    assert df.select(patents.sections(F.col("t"), 7)).first()[0] == {"summary": "é" * 7}
