"""The names that queries are held against are gathered from the table once, not at each step of the search."""

from remedex.plans import QUERIES, load_all


def test_the_table_is_not_in_the_plan(spark, tmp_path):
    load_all()
    spark.createDataFrame([(1, "small ring"), (2, "blot"), (3, "small ring")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["resolve_suggestions"](spark, str(tmp_path))
    assert "p_partkey" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["query"], r["names"]) for r in out.collect()} == {("smal ring", "small ring"), ("blot", "blot")}
