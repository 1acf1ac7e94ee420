"""Polls over several micro-batches and a restart, against the same table at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import live, stability

SCHEMA = "path string, at timestamp, size long"
AT = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stability.PROVIDER)
    yield
    spark.conf.set(key, before)


def put(spark, path, rows):
    spark.createDataFrame([(p, AT(t), s) for p, t, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drained(spark, tmp_path, late="0 seconds"):
    polls = live.read_events(spark, str(tmp_path / "in"), SCHEMA)
    live.run_to(stability.told(polls, "path", "at", F.col("size"), late=late), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    rows = spark.read.schema("key string, kind string, at timestamp, size long").parquet(str(tmp_path / "out")).collect()
    return sorted((r.key or "", (r.at - AT(0)).total_seconds(), r.kind, r["size"]) for r in rows)


def test_settled_and_silent_over_micro_batches(spark, tmp_path, state_store):
    inbox = str(tmp_path / "in")
    put(spark, inbox, [("a", 0, 10), ("b", 0, 0), ("c", 0, 7)])
    put(spark, inbox, [("a", 2, 12), ("b", 2, 0), ("c", 2, 7), ("c", 4, 7), (None, 1, 3), ("d", None, 3), ("d", 1, None)])
    put(spark, inbox, [("a", 4, 12), ("b", 4, 5)])
    first = [("a", 4.0, "settled", 12), ("c", 2.0, "settled", 7)]
    assert [r for r in drained(spark, tmp_path) if r[2] == "settled"] == first
    # started again: a file that is told stays told; c fell silent and comes back
    put(spark, inbox, [("a", 6, 12), ("b", 6, 5), ("a", 18, 12), ("a", 5, 99)])
    put(spark, inbox, [("c", 30, 7), ("c", 32, 7), ("a", 31, 12)])
    put(spark, inbox, [("z", 100, 1)])
    rows = drained(spark, tmp_path)
    assert [r for r in rows if r[0] == "a"] == [("a", 4.0, "settled", 12), ("a", 30.0, "silent", 12), ("a", 43.0, "silent", 12)]
    assert [r for r in rows if r[0] == "b"] == [("b", 6.0, "settled", 5), ("b", 18.0, "silent", 5)]
    assert [r for r in rows if r[0] == "c"] == [("c", 2.0, "settled", 7), ("c", 16.0, "silent", 7), ("c", 32.0, "settled", 7), ("c", 44.0, "silent", 7)]
    assert not [r for r in rows if r[0] == "d"]


def test_any_micro_batches_equal_the_table(spark, tmp_path, state_store):
    rng, rows = random.Random(6), []
    for p in "abcdef":
        t = 0
        for _ in range(25):
            t += rng.choice([1, 2, 2, 3, 12, 13, 20])
            rows.append((p, t, rng.choice([0, 5, 5, 6])))
    rows.sort(key=lambda r: r[1])
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        put(spark, str(tmp_path / "in"), rows[a:b])
    put(spark, str(tmp_path / "in"), [("end", 10_000, 1)])
    got = [r for r in drained(spark, tmp_path, "5 seconds") if r[0] != "end"]
    table = spark.createDataFrame([(p, AT(t), s) for p, t, s in rows], SCHEMA)
    want = sorted((r.key, (r.at - AT(0)).total_seconds(), r.kind, r["size"]) for r in stability.told_of(table, "path", "at", F.col("size")).collect())
    assert got == want
