"""The merge of first values against its SQL: ties, nulls, repeated and missing keys."""

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
LINE = "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double"
PART = "p_partkey long, p_size int"
ROWS = [
    (1, 5, 1, 8.0), (1, 5, 1, 3.0), (1, 5, 1, 9.0), (1, 6, 1, 1.0),  # ties: the first in the file counts
    (2, 1, 1, None), (2, 2, 1, 4.0), (3, 1, 1, None),  # null values replace nothing
    (4, None, 1, 1.0), (4, 7, None, 2.0), (4, 7, 2, 5.0), (5, None, 3, 6.0), (5, None, 2, 7.0),  # null orders come last
    (8, 2, 1, 2.5), (8, 2, 1, 1.5), (9, 1, 1, None), (None, 1, 1, 3.5),  # keys that the target lacks
]
PARTS = [(1, 10), (2, 20), (2, 21), (3, 30), (4, None), (5, 50), (6, 60)]


@pytest.mark.parametrize("parts", [PARTS, [*PARTS, (None, 70)], []])
@pytest.mark.parametrize("rows", [ROWS, ROWS[::-1], []])
def test_merge_follows_its_sql(spark, tmp_path, parts, rows):
    for name, data, schema in (("lineitem", rows, LINE), ("part", parts, PART)):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    c = duckdb.connect()
    for name in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in entry.queries()["app_upsert"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(c.sql(entry.oracle_sql()["app_upsert"]).fetchall(), key=repr)


def test_ties_go_by_the_place_in_the_files(spark, tmp_path):
    """Many rows of a key and order, in several files and row groups, read by several tasks."""
    rows = [(i % 50, 1, 1, float(7919 * i % 10007)) for i in range(10000)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.option("parquet.block.size", 4096).option("maxRecordsPerFile", 3000).parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, 0) for i in range(50)], PART).write.parquet(f"{tmp_path}/part.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.id: r.v for r in entry.queries()["app_upsert"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: rows[i][3] for i in range(50)}
