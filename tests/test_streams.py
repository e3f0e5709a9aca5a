"""Streams over several batches, restarts, late rows and large groups."""

from datetime import datetime

from pyspark.sql import functions as F

from tessel.operators.shared import fresh
from tessel.streaming import curation


def fed(spark, path, slices, schema):
    for k, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/slice={k}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_late_rows_are_left_out_and_windows_close(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    path, schema = fresh(spark, "late"), "ts timestamp, key string, value double"
    slices = [[(at(0, 10), "a", 1.0), (at(0, 50), "a", 3.0)], [(at(3), "a", 5.0)], [(at(3, 5), "a", 5.0)], [(at(0, 20), "a", 100.0), (at(2, 55), "a", 7.0)], [(at(6), "a", 9.0)], [(at(6, 1), "a", 9.0)]]
    stream = curation.windowed(fed(spark, path + "/in", slices, schema), "ts", "key", "value", "1 hour", delay="10 minutes")
    curation.drained(stream, path + "/out", path + "/state")
    got = {r.start.hour: (r.n, r["mean"]) for r in spark.read.parquet(path + "/out").collect()}
    assert got == {0: (2, 2.0), 2: (1, 7.0), 3: (2, 5.0)}  # 00:20 comes when the watermark has passed its window; the last window is open


def test_caps_count_on_over_chunks_batches_and_restarts(spark):
    path, schema = fresh(spark, "cap"), "key string, row long"
    slices = [[("a", i) for i in range(20, 0, -1)], [("a", 0), ("b", 5)], [("b", i) for i in range(20, 9, -1)]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        fed(spark, path + "/in", slices[:2], schema)
        stream = lambda: spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path + "/in")
        curation.drained(curation.capped(stream(), "key", "row", 4), path + "/out", path + "/state")
        spark.createDataFrame(slices[2], schema).coalesce(1).write.parquet(path + "/in/slice=9")
        curation.drained(curation.capped(stream(), "key", "row", 4), path + "/out", path + "/state")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = sorted((r.key, r.row) for r in spark.read.parquet(path + "/out").collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5), ("b", 10), ("b", 11), ("b", 12)]


def test_a_batch_that_runs_again_writes_the_same_quota(spark):
    path, schema = fresh(spark, "again"), "key string, row long, value double"
    stream = fed(spark, path + "/in", [[("a", i, float(i)) for i in range(5)], [("a", 9, 2.5), ("b", 1, 1.0)]], schema)
    columns = ["key", "row", "value"]
    run = curation.merge_quota(stream, path + "/out", "key", [F.desc("value"), "row"], 2, columns, path + "/state")
    run.awaitTermination()
    assert sorted((r.key, r.row) for r in spark.read.parquet(path + "/out/1").collect()) == [("a", 3), ("a", 4), ("b", 1)]
    assert sorted((r.key, r.row) for r in spark.read.parquet(path + "/out/0").collect()) == [("a", 3), ("a", 4)]
