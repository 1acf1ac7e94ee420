"""Queries of what is kept between runs: cached results, the log of jobs, settled files; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joblog
from tidemark.plans.q_sequence import events
from tidemark.sources.cache import Store
from tidemark.sources.files import micros, table
from tidemark.sources.scratch import Scratch
from tidemark.streaming import live, stability

KINDS = {"click": "submit", "purchase": "claim", "error": "recover", "view": "finish", "signup": "roll_back"}


def cached_totals(spark, sf_dir):
    """Users' totals before the last day's events came, then with them: only users of that day are computed again."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    last = (ev.agg(F.max(micros(F.col("ts")))).first()[0] or 0) - 86_400_000_000
    store = Store(spark, Scratch(spark, "cached").root, ["user_id"])
    totals = lambda rows: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"), F.count_if(F.col("event_type") == "error").alias("errors"))
    store.run(ev.filter(micros(F.col("ts")) <= last), totals).write.format("noop").mode("overwrite").save()
    return store.run(ev, totals)


def _log(spark, sf_dir):
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("event_type")]
    return events(spark, sf_dir).select((F.col("user_id") % 40).alias("job"), "event_id", kind.alias("kind"), (F.col("event_id") % 7).alias("worker"))


def job_replay(spark, sf_dir):
    return joblog.replayed(_log(spark, sf_dir), ["job"], ["event_id"])


def job_standing(spark, sf_dir):
    return joblog.standing(job_replay(spark, sf_dir), ["job"], ["event_id"])


def next_job(spark, sf_dir):
    standing = joblog.standing(job_replay(spark, sf_dir), ["job"], ["event_id"]).withColumn("queue", F.col("job") % 3)
    return joblog.next_queued(standing, ["job"], ["event_id"], ["queue"])


def stream_settled(spark, sf_dir):
    """Users as files: polls are events, sizes their values in tens, silence is six hours long."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    key, out = "spark.sql.streaming.stateStore.providerClass", Scratch(spark, "stream-settled")
    before = spark.conf.get(key)
    spark.conf.set(key, stability.PROVIDER)
    try:
        live.run_to(stability.told(rows, "user_id", "ts", F.floor(F.col("value") / 10), 6 * 3600.0), out.path("rows"), out.path("checkpoint"))
    finally:
        spark.conf.set(key, before)
    found = spark.read.schema("key long, kind string, at timestamp, size long").parquet(out.path("rows"))
    return found.select("key", "kind", F.col("at").cast("timestamp_ntz").alias("at"), "size")


REPLAY = """l AS (SELECT user_id % 40 AS job, event_id, CASE event_type WHEN 'click' THEN 'submit' WHEN 'purchase' THEN 'claim' WHEN 'error' THEN 'recover' WHEN 'view' THEN 'finish' WHEN 'signup' THEN 'roll_back' END AS kind, event_id % 7 AS worker FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY event_id) AS k FROM l),
  r AS (SELECT job, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, NULL::BIGINT AS worker, 'idle' AS before, 'idle' AS after FROM (SELECT DISTINCT job FROM l)
    UNION ALL SELECT n.job, n.k, n.event_id, n.kind, n.worker, r.after, CASE WHEN n.kind = 'submit' AND r.after IN ('idle', 'done') THEN 'queued' WHEN n.kind = 'claim' AND r.after = 'queued' THEN 'running' WHEN n.kind = 'recover' AND r.after = 'running' THEN 'queued'
      WHEN n.kind = 'finish' AND r.after = 'running' THEN 'done' WHEN n.kind = 'roll_back' AND r.after IN ('queued', 'running') THEN 'idle' ELSE r.after END FROM r JOIN n ON n.job = r.job AND n.k = r.k + 1),
  p AS (SELECT job, event_id, kind, worker, before, after, before <> after AS moved FROM r WHERE k > 0),
  s AS (SELECT job, arg_max(after, event_id) AS state, max(event_id) FILTER (moved) AS moved_event_id, count(*) FILTER (moved AND kind = 'claim') AS claims, arg_max(worker, event_id) FILTER (moved AND kind = 'claim') AS claimed_by, count(*) FILTER (NOT moved) AS ignored FROM p GROUP BY job)"""
SQL = {
    "cached_totals": "SELECT user_id, count(*) AS n, max(event_id) AS latest, count(*) FILTER (event_type = 'error') AS errors, max(ts) > (SELECT max(ts) - INTERVAL 1 DAY FROM events) AS recomputed FROM events GROUP BY user_id",
    "job_replay": f"WITH RECURSIVE {REPLAY} SELECT * FROM p",
    "job_standing": f"WITH RECURSIVE {REPLAY} SELECT * FROM s",
    "next_job": f"WITH RECURSIVE {REPLAY} SELECT job % 3 AS queue, arg_min(moved_event_id, moved_event_id) AS moved_event_id, arg_min(job, moved_event_id) AS job FROM s WHERE state = 'queued' GROUP BY 1",
    "stream_settled": """WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, floor(value / 10)::BIGINT AS size FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
  g AS (SELECT *, lag(size) OVER w AS before, ms - lag(ms) OVER w AS gap, lead(ms) OVER w - ms AS ahead FROM e WINDOW w AS (PARTITION BY key ORDER BY ms, size)),
  p AS (SELECT *, sum((gap IS NULL OR gap > 21600000)::INT) OVER (PARTITION BY key ORDER BY ms, size) AS part FROM g)
  SELECT key, 'settled' AS kind, make_timestamp(min(ms) * 1000) AS at, arg_min(size, ms) AS size FROM p WHERE gap <= 21600000 AND size = before AND size > 0 GROUP BY key, part
  UNION ALL SELECT key, 'silent', make_timestamp((ms + 21600000) * 1000), size FROM p WHERE ahead > 21600000 OR (ahead IS NULL AND ms + 21600000 <= (SELECT epoch_us(max(ts)) // 1000 - 60000 FROM events))""",
}
QUERIES = {f.__name__: f for f in (cached_totals, job_replay, job_standing, next_job, stream_settled)}
