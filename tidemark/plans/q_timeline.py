"""Queries of the whole flow, from raw readings to clips, on games made of the event table.

A user is a game: every event is a sample half a second after the last, purchases score two for
the home side and clicks three for the away side in turn, errors hide the display, and large
values misread a score.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sequence
from tidemark.plans import clips, timeline
from tidemark.plans.q_sequence import events
from tidemark.sources.scratch import Scratch

SPORT = timeline.SPORTS["basketball"]


def samples(spark, sf_dir):
    ev = events(spark, sf_dir)
    w = sequence.over(["user_id"], ["i"])
    home = 2 * F.sum(((F.col("event_type") == "purchase") & (F.col("i") % 4 == 0)).cast("int")).over(w)
    away = 3 * F.sum(((F.col("event_type") == "click") & (F.col("i") % 5 == 0)).cast("int")).over(w)
    left = F.greatest(F.lit(0), 720 - F.floor(F.col("i") / 2))
    shown = lambda score: F.when(F.col("value") > 120, (score + 40).cast("string")).otherwise(score.cast("string"))
    sure = F.when(F.col("value") > 100, 0.5).otherwise(0.9).cast("float")
    read = lambda text: F.struct(text.alias("text"), sure.alias("conf"))
    fields = F.create_map(
        F.lit("home_score"), read(shown(home)), F.lit("away_score"), read(shown(away)), F.lit("period"), read(F.lit("1st")),
        F.lit("clock"), read(F.concat(F.floor(left / 60).cast("string"), F.lit(":"), F.lpad((left % 60).cast("string"), 2, "0"))),
        F.lit("shot_clock"), read((24 - F.col("i") % 40 / 2).cast("int").cast("string")),
    )
    return ev.select(F.col("user_id").cast("string").alias("game_id"), F.col("i").cast("int").alias("i"), (F.col("i") / 2).alias("t"), (F.col("event_type") != "error").alias("visible"), fields.alias("fields"))


def timeline_build(spark, sf_dir):
    return timeline.build(samples(spark, sf_dir), SPORT)


def _kept(spark, sf_dir):
    """The timeline as a written table: several operators read it, the per-game folds run once."""
    return Scratch(spark, "timeline").write(timeline_build(spark, sf_dir), "timeline")


def timeline_quality(spark, sf_dir):
    return timeline.quality(timeline_build(spark, sf_dir))


def timeline_events(spark, sf_dir):
    return timeline.score_events(_kept(spark, sf_dir), SPORT).withColumn("notes", F.array_join("notes", "; "))


def timeline_clips(spark, sf_dir):
    scratch, tl = Scratch(spark, "clips"), _kept(spark, sf_dir)
    ev = scratch.write(timeline.score_events(tl, SPORT), "events")
    out = clips.build(tl, ev, SPORT, "home", clips.Options(opponent=True))
    spans = F.array_join(F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s["a"], s["b"])), ",")
    return out.select("game_id", "clip", "team", "kind", "points", "cause", "confidence", spans.alias("segments"), F.array_join("changes", ",").alias("changes"))


def timeline_window(spark, sf_dir):
    ev = timeline.score_events(_kept(spark, sf_dir), SPORT)
    return timeline.window_start(ev, "home", 0.5)


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (timeline_build, timeline_quality, timeline_events, timeline_clips, timeline_window)}
