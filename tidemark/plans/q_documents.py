"""Queries of documents and review filters on orders as clips, customers as games; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import documents
from tidemark.plans.q_sequence import EV, events
from tidemark.sources.files import table


def _clips(spark, sf_dir):
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("field_goal", "free_throws", "block", "steal")))
    segments = F.array(F.struct(k.cast("double").alias("a"), (k + k % 9).cast("double").alias("b")), F.struct((k + 20).cast("double").alias("a"), (k + 20.5).cast("double").alias("b")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("game_id"), k.alias("clip"), F.when(k % 2 == 0, "home").otherwise("away").alias("team"), F.get(kinds, (k % 4).cast("int")).alias("kind"), (k % 4).alias("points"),
        (k % 100 / 100).alias("confidence"), F.when(k % 5 == 0, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")).alias("warnings"), (k % 7 != 0).alias("enabled"), (k % 11 == 0).alias("edited"),
        F.when(k % 13 == 0, F.slice(segments, 1, 0)).otherwise(segments).alias("segments"),
    )


def review_filters(spark, sf_dir):
    out = documents.by_filter(_clips(spark, sf_dir), F.lit("home"))
    return out.select("game_id", "clip", "filter", "place", "place_by_confidence")


def cut_list(spark, sf_dir):
    return documents.cut_rows(_clips(spark, sf_dir)).select("game_id", "clip", "seconds", "out_start", "out_end")


def cut_documents(spark, sf_dir):
    """The documents read again: what they hold."""
    docs = documents.cut_documents(_clips(spark, sf_dir).select("game_id", "clip", "team", "enabled", "segments"))
    read = F.from_json("document", "game_id string, runtime_seconds double, n_clips bigint, clips array<struct<clip:bigint,team:string,segments:array<struct<a:double,b:double>>,out_end:double>>")
    d = docs.select("game_id", read.alias("d"))
    return d.select("game_id", F.col("d.runtime_seconds").alias("runtime_seconds"), F.col("d.n_clips").alias("n_clips"), F.array_join(F.transform("d.clips", lambda c: F.concat_ws("/", c["clip"].cast("string"), c["team"], F.size(c["segments"]).cast("string"))), ",").alias("clips"), F.element_at("d.clips", -1)["out_end"].alias("ends"))


def last_known(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = ev.select(F.col("user_id").cast("string").alias("game_id"), "i", F.when(F.col("event_type") == "click", F.col("event_id")).alias("score_away"), F.when(F.col("value") > 20, F.col("event_id")).alias("score_home"))
    return documents.final_scores(rows)


CLIPS = """k AS (SELECT o_custkey::VARCHAR AS game_id, o_orderkey AS clip, o_orderkey % 100 / 100.0::DOUBLE AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'home' ELSE 'away' END AS team, o_orderkey % 4 AS m FROM orders)"""
CUT = """c AS (SELECT o_custkey::VARCHAR AS game_id, o_orderkey AS clip, CASE WHEN o_orderkey % 2 = 0 THEN 'home' ELSE 'away' END AS team, (o_orderkey % 9 + 0.5)::DOUBLE AS seconds FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 13 <> 0),
  r AS (SELECT *, round(sum(seconds) OVER (PARTITION BY game_id ORDER BY clip), 3) AS out_end FROM c)"""
SQL = {
    "review_filters": f"""WITH {CLIPS}, f AS (
      SELECT *, 'all' AS filter FROM k UNION ALL SELECT *, team FROM (SELECT * REPLACE (CASE team WHEN 'home' THEN 'team' ELSE 'opp' END AS team) FROM k) UNION ALL SELECT *, 'scores' FROM k WHERE m IN (2, 3) UNION ALL SELECT *, 'ft' FROM k WHERE m = 1
      UNION ALL SELECT *, 'defense' FROM k WHERE m IN (2, 3) UNION ALL SELECT *, 'warnings' FROM k WHERE clip % 5 = 0 UNION ALL SELECT *, 'low' FROM k WHERE confidence < 0.7 UNION ALL SELECT *, 'off' FROM k WHERE clip % 7 = 0 UNION ALL SELECT *, 'edited' FROM k WHERE clip % 11 = 0)
      SELECT game_id, clip, filter, (row_number() OVER (PARTITION BY game_id, filter ORDER BY clip))::INT AS place, (row_number() OVER (PARTITION BY game_id, filter ORDER BY confidence, clip))::INT AS place_by_confidence FROM f""",
    "cut_list": f"WITH {CUT} SELECT game_id, clip, seconds, round(out_end - seconds, 3) AS out_start, out_end FROM r",
    "cut_documents": f"WITH {CUT} SELECT game_id, round(sum(seconds), 3) AS runtime_seconds, count(*) AS n_clips, string_agg(clip || '/' || team || '/2', ',' ORDER BY clip) AS clips, max(out_end) AS ends FROM r GROUP BY game_id",
    "last_known": f"WITH {EV} SELECT user_id::VARCHAR AS game_id, arg_max(event_id, i) FILTER (event_type = 'click') AS score_away, arg_max(event_id, i) FILTER (value > 20) AS score_home FROM ev GROUP BY user_id",
}
QUERIES = {f.__name__: f for f in (review_filters, cut_list, cut_documents, last_known)}
