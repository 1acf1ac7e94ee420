"""Clips of a game by the rules of its sport: which changes, from where to where, what hangs on what, and the closing fold.

``timeline`` and ``events`` are those of ``plans.timeline``; pass them as written tables, several
operators read them.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clipping, sequence, summaries
from tidemark.plans import rules
from tidemark.plans.timeline import KEY, ORDER, Sport, text_changes
from tidemark.sources.scratch import Scratch


@dataclass(frozen=True)
class Options:
    """What comes in: of which sides, and which follow-ups."""

    opponent: bool = False
    tail: bool = True
    and_one: bool = True
    free_throws: bool = True


#: Seconds before and after a block or steal, and before and after a try (fixed values).
DEFENSE, TRY = (3.0, 4.0), (3.0, 1.0)
DEFENSE_KINDS = ("block", "steal")
#: Where a play began without a countdown: cause, how old a sign may be, seconds back without one, that cause (fixed values).
PLAY_STARTS = {
    "hockey": ("faceoff", 15.0, 15.0, "15s_before"),
    "football": ("clock_start", 20.0, 12.0, "12s_before"),
    "baseball": ("final_pitch", 40.0, 12.0, "12s_before"),
}
#: Seconds a kind is made longer by when it is exported (fixed values).
EXTENDED = {"home_run": 5.0}


def extension(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, seconds in EXTENDED.items():
        out = F.when(kind == name, seconds).otherwise(out)
    return out


def breaks_of(timeline: DataFrame, step: float) -> DataFrame:
    return sequence.widened(timeline.withColumnRenamed("t_video", "t"), KEY, ORDER, F.col("live"), "t", step)


#: Samples in a row without a shot clock that show it was switched off, and seconds over its largest value that the game clock may read then (fixed values).
SWITCHED, ALLOWED = 4, 0.5


def switched_off(timeline: DataFrame, sport: Sport, step: float) -> DataFrame:
    """Where play went on but the shot clock went blank for good: less time is left than it shows. game_id, t."""
    rows = sequence.nearest_known(timeline.withColumnRenamed("t_video", "t"), KEY, ORDER, "clock", "left", 2)
    w = sequence.over(KEY, ORDER)
    rows = rows.withColumn("_on", F.min("live").over(w.rowsBetween(-1, SWITCHED - 1)) & F.min(F.coalesce("bug_visible", F.col("live")) if "bug_visible" in timeline.columns else F.col("live")).over(w.rowsBetween(0, SWITCHED - 1)))
    most = max(sport.resets, default=sport.shot_max) + ALLOWED
    gone = sequence.switched_off(rows, KEY, ORDER, "shot_clock", SWITCHED).filter(F.col("_on") & (F.col("left") <= most))
    return gone.select(*KEY, (F.col("t") - step / 2).alias("t"))


def resets_of(timeline: DataFrame, sport: Sport, step: float) -> DataFrame:
    """Shot clock resets: t, and t_start, from where the value counts down (a full second before its first fall)."""
    live = timeline.filter("live AND shot_clock IS NOT NULL").withColumnRenamed("t_video", "t")
    falls = sequence.upward_jumps(live, KEY, ORDER, "shot_clock", "t", 1.0, 40.0).select(*KEY, "i", "fall_at")
    found = clipping.resets(live, KEY, "shot_clock", "t", "i", sport.resets, int(3 / step)).join(falls, [*KEY, "i"])
    at = F.col("reset_at") - step / 2
    return found.select(*KEY, at.alias("t"), F.greatest(at, F.coalesce(F.col("fall_at") - step / 2 - 1.0, at)).alias("t_start"))


def clock_starts_of(timeline: DataFrame, step: float, fresh: tuple[float, ...] = ()) -> DataFrame:
    """Where the game clock began to run: game_id, at. The shot clock starts with it, so its first fall narrows the moment."""
    return sequence.clock_starts(timeline.withColumnRenamed("t_video", "t"), KEY, ORDER, "clock", "shot_clock", "t", "live", step, fresh).drop("stopped_for")


def counts_of(timeline: DataFrame) -> DataFrame:
    """Changes of baseball's count: game_id, at. A timeline without texts has none."""
    if "extra" not in timeline.columns:
        return timeline.limit(0).select(*KEY, F.lit(None).cast("double").alias("at"))
    return text_changes(timeline, "count").select(*KEY, F.col("t").alias("at"))


def clock_stops_of(timeline: DataFrame) -> DataFrame:
    """Where the game clock first shows a value that it then holds for two and a half seconds."""
    runs = sequence.runs(timeline.filter("live AND clock IS NOT NULL").withColumnRenamed("t_video", "t"), KEY, ORDER, "clock", "i", "t")
    return runs.filter(F.col("t_last") - F.col("t_first") >= 2.4).select(*KEY, F.col("t_first").alias("t"))


def starts(changes: DataFrame, all_changes: DataFrame, timeline: DataFrame, breaks: DataFrame, resets: DataFrame | None, sport: Sport, step: float, counts: DataFrame | None = None) -> DataFrame:
    """Changes (t, team, made) with ``start`` and ``cause`` by the rules of the sport.

    Football takes the snap (``snap``, the clock at it) where there is one, baseball changes of the
    count (``counts``: at; those of the timeline's texts if not given); basketball the latest of six signs before the make.
    """
    clock = clock_starts_of(timeline, step, sport.resets)
    if sport.name in PLAY_STARTS:
        cause, reach, back, otherwise = PLAY_STARTS[sport.name]
        signs = clock if sport.name != "baseball" else (counts if counts is not None else counts_of(timeline))
        out = rules.last_sign(changes, signs, KEY, reach, back, cause, otherwise)
        if sport.name == "football" and "snap" in changes.columns:
            out = rules.snap_times(out, timeline)
            out = out.withColumn("cause", F.when(F.col("snap_t").isNotNull(), "snap").otherwise(F.col("cause"))).withColumn("start", F.coalesce("snap_t", "start")).drop("snap_t")
        return out
    roll, off = sport.rolls[0], switched_off(timeline, sport, step)
    signs = [
        all_changes.select(*KEY, F.col("t").alias("at"), (F.col("t") + roll).alias("start"), F.col("team").alias("cause")),
        breaks.select(*KEY, F.col("b").alias("at"), F.when(F.col("b") - F.col("a") >= 4.0, F.col("b") + roll).alias("start"), F.lit("bug_returned").alias("cause")),
        resets.select(*KEY, F.greatest("t", "t_start").alias("at"), F.col("t_start").alias("start"), F.lit("shot_clock").alias("cause")),
        off.select(*KEY, F.col("t").alias("at"), F.col("t").alias("start"), F.lit("shot_clock").alias("cause")),
        clock.select(*KEY, "at", F.col("at").alias("start"), F.lit("clock_start").alias("cause")),
    ]
    union = functools.reduce(DataFrame.unionByName, signs)
    # before the make by more than its own timing is sure of, so its own reset isn't a sign
    limited = changes.withColumn("limit", F.coalesce(F.col("made") - 0.75, F.col("t") - 2.5))
    return clipping.last_starts(limited, union, KEY, ["home", "away", "bug_returned", "shot_clock", "clock_start"], sport.max_clip).drop("limit")


def build(timeline: DataFrame, events: DataFrame, sport: Sport, follow: str, options: Options = Options(), t_min: float | None = None, t_max: float | None = None, defense: DataFrame | None = None, counts: DataFrame | None = None, rate: float = 2.0) -> DataFrame:
    """Clips of the followed side (and the other, if asked) between two times.

    events may have ``matched`` (kinds of their plays) and ``snap``. defense: game_id, t, team, kind.
    A score that appears after a break ends where the break began. Segments lose what is not live,
    what is outside the game, and what is short; clips that meet fold into one or are cut.
    """
    step, scratch = 1.0 / rate, Scratch(timeline.sparkSession, "clips")
    # each is read by several of the steps below
    breaks = scratch.write(breaks_of(timeline, step), "breaks")
    resets = scratch.write(resets_of(timeline, sport, step), "resets") if sport.resets else None
    sides = ["home", "away"] if options.opponent else [follow]
    inside = F.col("t").between(F.lit(float("-inf") if t_min is None else t_min), F.lit(float("inf") if t_max is None else t_max))
    held = F.coalesce("held", F.lit(0.0))
    matched = F.col("matched") if "matched" in events.columns else F.lit(None).cast("array<string>")
    typed = events.withColumn("stopped", held >= 2.4).withColumn("stopped_for", held).withColumn("held_clock", F.col("clock"))
    typed = typed.withColumn("kind", rules.kind(sport.name, F.col("points"), F.col("stopped"), F.col("stopped_for"), matched))
    kept = clipping.chosen(clipping.followed(typed, KEY), KEY, F.col("team").isin(sides) & inside, options.tail, options.and_one, options.free_throws)

    cut_off = scratch.write(clipping.gap_before(kept, breaks, KEY, step), "kept")
    is_play = F.col("role").isNull() & (F.col("kind") != clipping.FREE)
    anchored = cut_off.filter(is_play).withColumn("anchored", F.col("gap_a").isNotNull()).withColumn("shown", F.col("t")).withColumn("t", F.coalesce("gap_a", "t"))
    made = clipping.make_times(anchored, resets, clock_stops_of(timeline), KEY) if sport.name == "basketball" else anchored.withColumn("made", F.lit(None).cast("double"))
    begun = starts(made, events, timeline, breaks, resets, sport, step, counts)
    end = F.when(F.col("anchored"), F.col("t")).otherwise(clipping.clip_end(F.col("t"), F.col("made"), sport.rolls[1]))
    span = clipping.bounded(F.col("start") - sport.rolls[0], end, F.col("cause"), sport.min_clip, sport.max_clip)
    plays = begun.withColumn("_s", span).select(
        *KEY, "event_index", "clip", "team", "kind", F.col("_s.a").alias("a"), F.col("_s.b").alias("b"), F.col("_s.cause").alias("cause"),
        (F.col("anchored") | F.col("_s.trimmed")).alias("warned"),
    )
    if sport.name == "basketball":
        lag = clipping.typical_lag(events, resets, KEY)
        before, after = clipping.free_throw_window(F.col("lag"))
    else:
        lag = None
        before, after = F.lit(TRY[0]), F.lit(TRY[1])
    short = cut_off.filter(~is_play)
    short = (short.join(lag, KEY, "left") if lag is not None else short).select(
        *KEY, "event_index", "clip", "team", "kind", (F.col("t") - before).alias("a"), (F.col("t") + after).alias("b"),
        F.when(F.col("role").isNull(), "free_throw").alias("cause"), (F.col("role").isNull() & (F.col("points") > 1)).alias("warned"),
    )
    drawn = plays.unionByName(short)
    if defense is not None:
        w = sequence.over(KEY, ["t", "team", "kind"])
        alone = defense.filter(F.col("team").isin(sides) & inside).withColumn("clip", -F.row_number().over(w))
        drawn = drawn.unionByName(alone.select(*KEY, F.col("clip").alias("event_index"), "clip", "team", "kind", (F.col("t") - DEFENSE[0]).alias("a"), (F.col("t") + DEFENSE[1]).alias("b"), F.lit("defense").alias("cause"), F.lit(False).alias("warned")))
    drawn = scratch.write(drawn.withColumn("clip", F.col("clip").cast("long")), "drawn")

    length = timeline.groupBy(*KEY).agg((F.max("t_video") + step).alias("duration"))
    cleared = scratch.write(clipping.cleared(drawn.select(*KEY, "clip", "team", "a", "b"), breaks, KEY, length), "cleared")
    pieces = scratch.write(clipping.settle(cleared, KEY), "pieces")
    joined = clipping.intervals.merge(pieces, [*KEY, "into"])
    segments = joined.groupBy(*KEY, "into").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("segments"))
    parts = pieces.select(*KEY, "clip", "into").distinct()
    whole = drawn.join(parts, [*KEY, "clip"])
    # the last score's kind names a clip that isn't only a free throw or a defensive play
    rank = F.when(F.col("kind").isin(*DEFENSE_KINDS), 1).when(F.col("kind") == clipping.FREE, 0).otherwise(2)
    heads = whole.filter(F.col("cause").isNotNull()).groupBy(*KEY, "into").agg(
        F.max_by("kind", F.struct(rank, "b")).alias("kind"), F.min_by("cause", F.struct("a", "clip")).alias("cause"), F.max("warned").alias("warned"), F.first("team").alias("team"),
    )
    scored = cut_off.withColumn("clip", F.col("clip").cast("long")).join(parts, [*KEY, "clip"])
    sums = clipping.totals(scored, KEY, "into")
    weak = scored.groupBy(*KEY, "into").agg(F.min("conf").alias("_least"), F.max(F.size("notes") > 0).alias("_noted"), F.array_sort(F.collect_set("event_index")).alias("changes"))
    out = segments.join(heads, [*KEY, "into"]).join(sums, [*KEY, "into"], "left").join(weak, [*KEY, "into"], "left")
    trimmed = F.col("cause").contains("max_length") | F.col("cause").contains("trimmed")
    sure = summaries.clip_confidence(F.coalesce("_least", F.lit(1.0)), trimmed, F.col("warned") | F.coalesce("_noted", F.lit(False)))
    extra = extension(F.col("kind"))
    return out.withColumn("confidence", sure).withColumn("points", F.coalesce("points", F.lit(0))).withColumn("extend", extra).drop("_least", "_noted", "warned").withColumnRenamed("into", "clip")
