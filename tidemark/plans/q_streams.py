"""Queries that drain the event table as a stream and read what was written, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.q_sequence import EV
from tidemark.sources.files import table
from tidemark.sources.scratch import Scratch
from tidemark.streaming import live


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # the event table is one file or one folder beside others
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_changes(spark, sf_dir):
    out = Scratch(spark, "stream-changes")
    found = live.changes(_stream(spark, sf_dir), "user_id", "ts", "event_type", "event_id")
    live.run_to(found, out.path("rows"), out.path("checkpoint"))
    rows = spark.read.schema("user_id long, event_id long, old string, new string, late boolean").parquet(out.path("rows"))
    return rows.filter("not late").drop("late")


def stream_failures(spark, sf_dir):
    out = Scratch(spark, "stream-failures")
    counts = live.failures(_stream(spark, sf_dir), "user_id", "ts", F.col("event_type") == "error", "12 hours", "6 hours", "1 hour")
    # complete windows only: the watermark passes the last ones when a later event comes
    live.run_to(counts.select("user_id", F.col("window.start").alias("start"), "n"), out.path("rows"), out.path("checkpoint"))
    rows = spark.read.schema("user_id long, start timestamp, n long").parquet(out.path("rows"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


SQL = {
    "stream_changes": f"WITH {EV} SELECT user_id, event_id, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY i) AS old FROM ev) WHERE event_type IS DISTINCT FROM old",
    "stream_failures": """WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e),
      w AS (SELECT user_id, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS start FROM e)
      SELECT user_id, start, count(*) AS n FROM w, m WHERE start + INTERVAL 12 HOUR <= mark GROUP BY 1, 2""",
}
QUERIES = {f.__name__: f for f in (stream_changes, stream_failures)}
