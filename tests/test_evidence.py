"""Evidence of a short list of names: texts are not dealt by what they start with."""

from remedex.operators import advice


def test_texts_stay_where_they_are(spark):
    texts = ["The reader went with it", "a reading", None, "misreader", "élan reader", "x " * 500 + "reader's"]
    articles = spark.createDataFrame([(t,) for t in texts], "text string")
    names = spark.createDataFrame([("reader",), ("The",), ("r",), ("absent",), ("reader",)], "name string")
    found = advice.evidence(articles, names, ("with",))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("The", 1, 1, "evidence-backed"), ("absent", 0, 0, "score-only"), ("r", 4, 1, "evidence-backed"), ("reader", 3, 1, "evidence-backed"), ("reader", 3, 1, "evidence-backed"),
    ]
    assert "hashpartitioning(start" not in found._jdf.queryExecution().executedPlan().toString()
