"""What a walk leaves on disk."""

import os
import time

from remedex.operators.walks import converged
from remedex.sources.settle import shared_folder, tidy

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_shuffle_files_go_when_a_query_ends(spark, tmp_path):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, setting = files(), spark.conf.get(CLEANUP)
    with tidy(spark):
        spark.range(1000).repartition(3).write.parquet(f"{tmp_path}/x")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(CLEANUP) == setting


def test_a_walk_leaves_its_result_and_no_uncompressed_rows(spark):
    checkpoints = lambda: sorted(f for _, dirs, _ in os.walk(shared_folder(spark).removeprefix("file://")) for f in dirs if f.startswith("rdd-"))
    before = checkpoints()
    w = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    p = {r.id: r.p for r in converged(w, spark.createDataFrame([("a", 1.0)], "id string, p double")).collect()}
    assert abs(p["a"] - 0.3 / 0.51) < 1e-9 and abs(p["b"] - 0.21 / 0.51) < 1e-9
    assert checkpoints() == before
