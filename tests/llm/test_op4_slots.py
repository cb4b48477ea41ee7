"""The slots of a mix grow with the documents, so the driver never holds them."""

import re

from remedex.llm import op4_source_mixing as op
from remedex.llm.common import Scratch


def test_slots_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(200)), f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    for df in (op.taken(*op.mix(docs, Scratch(spark))), op.mixed_documents(docs, Scratch(spark))):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan
        joins = re.findall(r"(\w+Join) \[number#\d+, block#\d+L\]", plan.split("== Initial Plan ==")[0])
        assert joins and set(joins) == {"SortMergeJoin"}  # before, adaptive execution broadcast the slots while their shuffled bytes were few
