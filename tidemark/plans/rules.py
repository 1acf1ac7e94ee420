"""Rules by sport: kinds of scores, where a scoring play began, and the part of a game asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import review, summaries
from tidemark.plans.timeline import KEY, Sport, game_seconds, period_name


def kind(sport: str, points: Column, stopped: Column, stopped_for: Column, matched: Column, long_stop: float = 8.0) -> Column:
    """Kind of a score from the kinds of the plays it was matched to (array, NULL or empty if none), else from what the display shows."""
    known = F.filter(F.coalesce(matched, F.array().cast("array<string>")), lambda k: k.isNotNull())
    if sport == "hockey":
        return F.lit("goal")
    if sport == "baseball":
        return F.when(F.array_contains(known, "home_run"), "home_run").otherwise("run")
    if sport == "football":
        last = F.try_element_at(matched, F.lit(-1))
        two = F.when(last.isin("two_point", "safety"), last).when(stopped, "two_point").otherwise("safety")
        return F.when(points >= 6, "touchdown").when(points == 3, "field_goal").when(points == 1, "extra_point").when(points == 2, two).otherwise("score")
    free = F.when(F.size(known) > 0, F.forall(known, lambda k: k == "free_throw")).otherwise((points == 1) | F.coalesce(stopped & (stopped_for >= long_stop), F.lit(False)))
    return F.when(free, "free_throws").otherwise("field_goal")


def last_sign(changes: DataFrame, signs: DataFrame, key: list[str], reach: float, back: float, cause: str, otherwise: str) -> DataFrame:
    """Changes with ``start``: the last sign strictly before ``t`` if at most ``reach`` old, else ``back`` before ``t``; and its cause.

    Hockey takes faceoffs (reach and back 15), football clock starts (20, 12), baseball changes of
    the count (what fits in a clip, 12). One window over both tables, ordered by time.
    """
    rows = changes.select(*key, F.col("t").alias("_at"), F.lit(0).alias("_sign"), F.struct(*[c for c in changes.columns if c not in key]).alias("_c"))
    both = rows.unionByName(signs.select(*key, F.col("at").cast("double").alias("_at"), F.lit(1).alias("_sign")), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_at", "_sign").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last(F.when(F.col("_sign") == 1, F.col("_at")), ignorenulls=True).over(w)).filter("_sign = 0")
    near = F.coalesce(F.col("_at") - F.col("_last") <= reach, F.lit(False))
    return found.select(*key, "_c.*", F.when(near, F.col("_last")).otherwise(F.col("_at") - back).alias("start"), F.when(near, cause).otherwise(otherwise).alias("cause"))


def snap_times(changes: DataFrame, timeline: DataFrame, within: float = 0.5) -> DataFrame:
    """Changes with ``snap_t``: when the clock of their period last showed ``snap`` before them.

    Whole seconds of the clock are the join key: a reading within half a second lies in one of two.
    """
    shown = timeline.select(*KEY, "period", F.col("t_video").alias("_t"), F.col("clock").alias("_clock"), F.floor("clock").alias("_second"))
    cells = F.array_distinct(F.array(F.floor(F.col("snap") - within), F.floor(F.col("snap") + within)))
    asked = changes.select(*KEY, "event_index", "period", "t", "snap", F.explode(cells).alias("_second"))
    met = asked.join(shown, [*KEY, "period", "_second"]).filter((F.abs(F.col("_clock") - F.col("snap")) <= within) & (F.col("_t") < F.col("t")))
    return changes.join(met.groupBy(*KEY, "event_index").agg(F.max("_t").alias("snap_t")), [*KEY, "event_index"], "left")


def windows(asked: DataFrame, timeline: DataFrame, events: DataFrame, sport: Sport, step: float, runs: DataFrame | None = None) -> DataFrame:
    """Video times t_min and t_max of each game's asked part, with labels and notes.

    asked: game_id, follow, start_mode ('start', 'game_time', 'auto_run'), start_period, start_clock,
    end_mode ('end', 'game_time'), end_period, end_clock. runs: the biggest run by the plays, if
    there are any: game_id, run_period, run_clock, run_deficit, run_t (of the matched change).
    An automatic start is that change, else its game time, else the display's own low point.
    """
    if runs is None:
        runs = asked.sparkSession.createDataFrame([], "game_id string, run_period int, run_clock double, run_deficit int, run_t double")
    rows = asked.join(runs, KEY, "left")
    at = lambda period, clock: game_seconds(sport, F.col(period), F.coalesce(F.col(clock), F.when(F.col(period) <= sport.regulation, sport.period_seconds).otherwise(sport.overtime_seconds)))
    wanted = F.array(
        F.struct(F.lit("start").alias("of"), F.when(F.col("start_mode") == "game_time", at("start_period", "start_clock")).alias("target")),
        F.struct(F.lit("run").alias("of"), F.when(F.col("start_mode") == "auto_run", at("run_period", "run_clock")).alias("target")),
        F.struct(F.lit("end").alias("of"), F.when(F.col("end_mode") == "game_time", at("end_period", "end_clock")).alias("target")),
    )
    targets = rows.select(*KEY, F.explode(wanted).alias("x")).select(*KEY, "x.of", (F.col("x.target") - 1e-6).alias("target")).filter("target IS NOT NULL")
    read = F.col("live") & F.col("period").isNotNull() & (F.col("clock").isNotNull() if sport.clocked else F.lit(True))
    live = timeline.filter(read).select(*KEY, F.col("t_video").alias("t"), game_seconds(sport, F.col("period"), F.col("clock")).alias("e"))
    reached = review.first_at(live, targets, KEY, "t", "e", "target").groupBy(*KEY).agg(*(F.max(F.when(F.col("of") == n, F.col("found_t"))).alias(f"_{n}") for n in ("start", "run", "end")))
    home = F.col("follow") == "home"
    theirs = events.join(asked.select(*KEY, "follow"), KEY).filter(F.col("team") != F.col("follow"))
    theirs = theirs.withColumn("_own", F.when(home, F.col("score_home")).otherwise(F.col("score_away"))).withColumn("_other", F.when(home, F.col("score_away")).otherwise(F.col("score_home")))
    low = summaries.largest_deficit(theirs, KEY, "_own", "_other", ["t"], ["t", "period", "clock"]).select(*KEY, F.col("t").alias("_low_t"), F.col("period").alias("_low_period"), F.col("clock").alias("_low_clock"), F.col("deficit").alias("_low_deficit"))
    out = rows.join(reached, KEY, "left").join(low, KEY, "left")
    place = lambda period, clock: F.trim(F.concat_ws(" ", period_name(sport, period), parse.clock_label(clock)))
    auto, timed, till = F.col("start_mode") == "auto_run", F.col("start_mode") == "game_time", F.col("end_mode") == "game_time"
    by_play = F.coalesce("run_t", "_run")
    anchor, seen = F.coalesce(by_play, F.col("_low_t")), by_play.isNotNull()
    pick = lambda a, b: F.when(seen, F.col(a)).otherwise(F.col(b))
    run_label = F.concat(F.lit("Biggest run: down "), pick("run_deficit", "_low_deficit").cast("string"), F.lit(" at "), place(pick("run_period", "_low_period"), pick("run_clock", "_low_clock")))
    notes = F.array(
        F.when(timed & F.col("_start").isNull(), "start point not found; from the beginning"),
        F.when(auto & anchor.isNull(), "the followed side never trailed; from the beginning"),
        F.when(auto & ~seen & F.col("_low_t").isNotNull() & F.col("run_period").isNotNull(), "start of the run taken from the display; its play was not located"),
        F.when(till & F.col("_end").isNull(), "end point not found; to the end"),
    )
    return out.select(
        *KEY, F.when(timed, F.col("_start")).when(auto, anchor + step / 2).alias("t_min"), F.when(till, F.col("_end") + 2.5).alias("t_max"),
        F.coalesce(F.when(timed & F.col("_start").isNotNull(), place(F.col("start_period"), F.col("start_clock"))).when(auto & anchor.isNotNull(), run_label), F.lit("Start of game")).alias("start_label"),
        F.coalesce(F.when(till & F.col("_end").isNotNull(), place(F.col("end_period"), F.col("end_clock"))), F.lit("End of game")).alias("end_label"),
        F.filter(notes, lambda n: n.isNotNull()).alias("notes"),
    )
