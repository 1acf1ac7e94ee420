"""Streams in several micro-batches: late rows, rows without a time, a start from the checkpoint."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import live

SCHEMA = "k long, at timestamp, seen string, id long"
AT = lambda m: None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def put(spark, path, rows):
    spark.createDataFrame([(k, AT(m), s, i) for k, m, s, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drained(spark, tmp_path, schema, what):
    live.run_to(what(live.read_events(spark, str(tmp_path / "in"), SCHEMA)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()


def test_changes_over_micro_batches(spark, tmp_path):
    changed = lambda ev: live.changes(ev, "k", "at", "seen", "id")
    schema = "k long, at timestamp, id long, old string, new string, late boolean"
    put(spark, str(tmp_path / "in"), [(1, 5, "b", 2), (1, 0, "a", 1), (1, 6, "b", 3), (2, 0, None, 4), (2, 1, "x", 5)])
    first = sorted((r.id, r.old, r.new, r.late) for r in drained(spark, tmp_path, schema, changed))
    assert first == [(1, None, "a", False), (2, "a", "b", False), (5, None, "x", False)]
    # started again: equal values are no change, what comes late or without a time is marked and moves nothing
    put(spark, str(tmp_path / "in"), [(1, 3, "c", 6), (1, None, "d", 7), (1, 6, "b", 8), (1, 9, "a", 9), (3, 0, "n", 10)])
    rows = sorted((r.id, r.old, r.new, r.late) for r in drained(spark, tmp_path, schema, changed))
    assert rows == first + [(6, None, "c", True), (7, None, "d", True), (9, "b", "a", False), (10, None, "n", False)]


def test_failures_close_with_the_watermark(spark, tmp_path):
    count = lambda ev: live.failures(ev, "k", "at", F.col("seen") == "bad", "10 minutes", "10 minutes", "5 minutes").select("k", F.col("window.start").alias("start"), "n")
    schema = "k long, start timestamp, n long"
    put(spark, str(tmp_path / "in"), [(1, 1, "bad", 1), (1, 2, "good", 2), (1, 9, "bad", 3), (2, 3, "bad", 4)])
    assert drained(spark, tmp_path, schema, count) == []
    put(spark, str(tmp_path / "in"), [(1, 16, "bad", 5), (1, 8, "bad", 6)])
    put(spark, str(tmp_path / "in"), [(2, 40, "bad", 7)])
    rows = sorted((r.k, r.start.minute, r.n) for r in drained(spark, tmp_path, schema, count))
    assert rows == [(1, 0, 3), (1, 10, 1), (2, 0, 1)]
