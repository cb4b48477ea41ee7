from datetime import datetime, timedelta

from pyspark.sql import functions as F

from remedex.streaming import jobs

START = datetime(2024, 1, 1)


def events(spark, write_table):
    rows = [(i, START + timedelta(minutes=20 * i), i % 3, ("view", "purchase")[i % 2], float(i)) for i in range(30)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    d = write_table("events", rows, schema)
    return rows, jobs.read_events(spark, f"{d}/events.parquet", schema)


def test_windows_are_emitted_once_the_watermark_has_passed(spark, write_table, tmp_path):
    rows, stream = events(spark, write_table)
    jobs.to_table(jobs.windowed_counts(stream, "event_type"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for _, ts, _, kind, v in rows:
        k = (ts.replace(minute=0), kind)
        n, t = want.get(k, (0, 0.0))
        want[k] = (n + 1, t + v)
    assert got
    assert all(want[k] == v for k, v in got.items())
    assert len(got) >= len(want) - 2


def test_latest_states_as_a_table(spark, write_table, tmp_path):
    _, stream = events(spark, write_table)
    status = F.when(F.col("event_type") == "purchase", "completed").otherwise("running")
    q = jobs.upsert_to(jobs.latest_states(stream, "user_id", status), ["user_id"], f"{tmp_path}/t", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = {r["user_id"]: r["status"] for r in jobs.read_upserted(spark, f"{tmp_path}/t", 0).collect()}
    assert got == {0: "completed", 1: "running", 2: "completed"}


def test_later_batches_write_the_folders_they_touch(spark, tmp_path):
    """Batches of one file each: the last row of every key, untouched folders keep their version, replaced ones go."""
    import os

    want = {}
    for n, keys in enumerate((range(60), range(3), range(1, 5), range(60, 63))):
        spark.createDataFrame([(k, f"{n}-{k}") for k in keys], "k long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        want |= {k: f"{n}-{k}" for k in keys}
        stream = spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.upsert_to(stream, ["k"], f"{tmp_path}/t", f"{tmp_path}/ck", folders=8).awaitTermination(120)
        assert {r.k: r.v for r in jobs.read_upserted(spark, f"{tmp_path}/t", n).collect()} == want
    versions = jobs._versions(spark, f"{tmp_path}/t", 3)
    assert 0 in versions.values() and len(set(versions.values())) > 1
    kept = {(int(v[1:]), int(f.split("=")[1])) for v in os.listdir(f"{tmp_path}/t/data") if v[0] == "v" for f in os.listdir(f"{tmp_path}/t/data/{v}") if "=" in f}
    now, before = ({(v, f) for f, v in jobs._versions(spark, f"{tmp_path}/t", n).items()} for n in (3, 2))
    assert now <= kept <= now | before
