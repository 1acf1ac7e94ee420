"""From raw readings to a clean timeline and score changes: operators composed per game.

``samples`` rows: game_id, i, t, visible, fields (map of text and confidence).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import parse
from tidemark.operators import folds, sequence, summaries

KEY, ORDER = ["game_id"], ["i"]
LIVE, HIDDEN, REPLAY = 1, 0, 2


@dataclass(frozen=True)
class Sport:
    """Fixed values of a sport."""

    name: str
    regulation: int
    period_seconds: float
    overtime_seconds: float
    shot_max: float
    resets: tuple[float, ...]
    most_points: int
    rolls: tuple[float, float]
    min_clip: float = 3.0
    max_clip: float = 30.0
    prefix: str = "Q"
    reader: str = "quarter"
    colon_led: bool = False
    clocked: bool = True
    texts: tuple[str, ...] = ()


SPORTS = {
    "basketball": Sport("basketball", 4, 720.0, 300.0, 24.0, (24.0, 14.0), 3, (1.0, 1.5)),
    "football": Sport("football", 4, 900.0, 600.0, 40.0, (40.0, 25.0), 8, (2.0, 2.0), colon_led=True, texts=("down_distance",)),
    "hockey": Sport("hockey", 3, 1200.0, 300.0, 24.0, (), 1, (1.0, 2.0), prefix="P", reader="overtime"),
    "baseball": Sport("baseball", 9, 0.0, 0.0, 0.0, (), 4, (3.0, 2.0), max_clip=45.0, prefix="", reader="inning", clocked=False, texts=("count", "outs")),
}
SCORE_CONF, CLOCK_CONF = 0.45, 0.30


def readings(samples: DataFrame, sport: Sport) -> DataFrame:
    """Typed readings of the trusted fields, and the weakest confidence of the ones that matter."""
    # columns of their own: readers name a text many times, and each time would look it up in the map again
    names = ("away_score", "home_score", "period", "shot_clock", *(("clock",) if sport.clocked else ()), *sport.texts)
    samples = samples.select(
        *KEY, "i", "t", "visible", *(F.coalesce(F.col("fields")[f]["text"], F.lit("")).alias(f"_text_{f}") for f in names),
        *(F.coalesce(F.col("fields")[f]["conf"], F.lit(0).cast("float")).alias(f"_conf_{f}") for f in names),
    )
    text, conf = (lambda f: F.col(f"_text_{f}")), (lambda f: F.col(f"_conf_{f}"))
    # a reader in a lambda names its text once and stays out of the generated method, which would grow too large to be compiled
    read = lambda f, reader: F.get(F.transform(F.array(text(f)), reader), 0)
    of = lambda f, least, reader: parse.trusted(text(f), conf(f), F.col("visible"), least, read(f, reader))
    clock = of("clock", CLOCK_CONF, lambda x: parse.clock_by(F.lit(sport.colon_led), x)) if sport.clocked else F.lit(None).cast("double")
    shot = of("shot_clock", CLOCK_CONF, lambda x: parse.shot_clock(x))
    sure = [conf(f) for f in ("away_score", "home_score", *(("clock",) if sport.clocked else ()))]
    return samples.select(
        *KEY, "i", "t", "visible",
        of("period", CLOCK_CONF, lambda x: parse.period_by(F.lit(sport.reader), x, F.lit(sport.regulation))).cast("double").alias("period_raw"),
        F.when(clock <= sport.period_seconds + 0.5, clock).alias("clock_raw"),
        F.when(shot <= sport.shot_max + 0.5, shot).alias("shot_raw"),
        of("away_score", SCORE_CONF, lambda x: parse.score(x)).cast("double").alias("away_raw"),
        of("home_score", SCORE_CONF, lambda x: parse.score(x)).cast("double").alias("home_raw"),
        F.least(*sure).alias("conf_raw"),
        *(of(f, CLOCK_CONF, parse.note).alias(f"text_{f}") for f in sport.texts),
    )


CLEANED = [
    ("period", T.DoubleType()), ("on_chain", T.BooleanType()), ("state", T.IntegerType()), ("score_away", T.DoubleType()), ("score_home", T.DoubleType()),
    ("away_read", T.BooleanType()), ("home_read", T.BooleanType()), ("shot_clock", T.DoubleType()),
]


def _lasting(mask: np.ndarray, least: int = 3, gap: int = 1) -> np.ndarray:
    """Runs of True with gaps of up to ``gap`` and at least ``least`` Trues, gaps included."""
    out, at = np.zeros(len(mask), bool), np.flatnonzero(mask)
    if len(at):
        for run in np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1):
            if len(run) >= least:
                out[run[0] : run[-1] + 1] = True
    return out


def clean_game(rows: folds.Entity, sport: Sport) -> list[np.ndarray]:
    """The columns of ``CLEANED`` for one game's ordered readings."""
    visible, clock = rows["visible"].astype(bool), rows["clock_raw"].astype(float)
    raw = rows["period_raw"].astype(float)
    if np.isnan(raw).all():
        period = folds.period_of_clock(clock, sport.period_seconds)
    else:
        known = np.flatnonzero(~np.isnan(raw))
        period = np.full(len(raw), np.nan)
        kept = known[folds.longest_chain(raw[known])]
        period[kept] = raw[kept]
        period = folds.neighbours_fill(period)
    whole = np.minimum(period - 1, sport.regulation) * sport.period_seconds + np.maximum(period - 1 - sport.regulation, 0) * sport.overtime_seconds
    elapsed = whole + np.maximum(0, np.where(period <= sport.regulation, sport.period_seconds, sport.overtime_seconds) - clock)
    timed = np.flatnonzero(~np.isnan(elapsed))
    on_chain = np.zeros(len(rows), bool)
    on_chain[timed[folds.longest_chain(elapsed[timed])]] = True
    off = ~np.isnan(elapsed) & ~on_chain
    state = np.where(visible, LIVE, HIDDEN)
    state[_lasting(off) & visible] = REPLAY
    replay = state == REPLAY
    sides = {s: folds.clean_score(rows[f"{s}_raw"].astype(float), state == LIVE, replay) for s in ("away", "home")}
    behind = sides["away"][2] | sides["home"][2]
    if behind.any():
        state[behind & visible] = REPLAY
        sides = {s: folds.clean_score(rows[f"{s}_raw"].astype(float), state == LIVE, replay) for s in ("away", "home")}
    shot = np.where(state == LIVE, rows["shot_raw"].astype(float), np.nan)
    shot[~folds.plausible(shot, rows["t"].astype(float), sport.resets)] = np.nan
    return [period, on_chain, state, sides["away"][0], sides["home"][0], sides["away"][1], sides["home"][1], shot]


def build(samples: DataFrame, sport: Sport, rate: float = 2.0, fill_gap: float = 6.0) -> DataFrame:
    """The timeline: states, period, filled clock, cleaned scores and shot clock, running flag, confidence."""
    clean = folds._grouped(readings(samples, sport), KEY, ORDER, CLEANED, lambda rows: clean_game(rows, sport))
    live = F.col("state") == LIVE
    read = clean.withColumn("live", live).withColumn("clock_read", F.col("on_chain") & live).withColumn("_clock", F.when(F.col("clock_read"), F.col("clock_raw")))
    filled = sequence.interpolate(read, KEY, ORDER, "t", "_clock", "clock", fill_gap, same="period").withColumn("clock", F.when(F.col("live"), F.col("clock")))
    moving = sequence.running(filled, KEY, ORDER, "clock", "clock_running", max(1, round(rate)), 0.05)
    return moving.select(
        *KEY, "i", F.col("t").alias("t_video"), F.col("visible").alias("bug_visible"), F.col("period").cast("int").alias("period"), "clock", "shot_clock",
        F.col("score_home").cast("int").alias("score_home"), F.col("score_away").cast("int").alias("score_away"),
        F.when(F.col("live"), F.col("conf_raw")).otherwise(F.lit(0).cast("float")).alias("confidence"), "live",
        (F.col("clock_running") & F.col("live") & F.col("clock").isNotNull()).alias("clock_running"), F.col("state").cast("tinyint").alias("state"), "clock_read", "home_read", "away_read",
        *([F.create_map(*(x for f in sport.texts for x in (F.lit(f), F.when(F.col("live"), F.col(f"text_{f}"))))).alias("extra")] if sport.texts else []),
    )


def text_changes(timeline: DataFrame, name: str, hold: int = 2) -> DataFrame:
    """Changes of a field that is kept as text: game_id, i, t, old, new; a text counts once ``hold`` samples in a row show it."""
    rows = timeline.select(*KEY, "i", F.col("t_video").alias("t"), F.col("extra")[name].alias("text"))
    return sequence.held_changes(rows, KEY, ORDER, "text", hold)


def game_seconds(sport: Sport, period: Column, clock: Column) -> Column:
    """How far a game has come; without a clock that is its half-inning."""
    return parse.elapsed(period, clock, sport.regulation, sport.period_seconds, sport.overtime_seconds) if sport.clocked else period.cast("double")


def period_name(sport: Sport, period: Column) -> Column:
    return parse.period_label(period, sport.regulation, sport.prefix) if sport.clocked else parse.inning_label(period)


def quality(timeline: DataFrame) -> DataFrame:
    """Counts and shares that tell how well a game could be read."""
    live = F.greatest(F.lit(1), F.count_if(F.col("live")))
    return timeline.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("bug_visible")).alias("visible"), F.count_if(F.col("live")).alias("live"), F.count_if(F.col("state") == REPLAY).alias("replay_samples"),
        F.round(F.count_if(F.col("live") & F.col("clock").isNull()) / live, 4).alias("clock_unreadable"),
        F.round(F.count_if(F.col("live") & ~(F.col("away_read") & F.col("home_read"))) / live, 4).alias("score_unreadable"),
        F.round(F.count_if(F.col("shot_clock").isNotNull()) / live, 4).alias("shot_clock_seen"),
    )


def score_events(timeline: DataFrame, sport: Sport) -> DataFrame:
    """Score changes of both sides in order, with clock, stoppage and confidence around them."""
    tl = timeline.withColumnRenamed("t_video", "t")
    w = Window.partitionBy(*KEY).orderBy("i")
    near = sequence.nearest_known(tl, KEY, ORDER, "clock", "clock_near", 3).withColumn("conf", F.min("confidence").over(w.rowsBetween(0, 1)))
    held = sequence.held_for(near, KEY, ORDER, "clock", "t", "held", 180.0, F.col("live") & F.col("clock").isNotNull())
    side = lambda team: F.struct(F.lit(team).alias("team"), F.col(f"score_{team}").alias("score"), F.col(f"{team}_read").alias("read"))
    sides = held.withColumn("clock", F.col("clock_near")).withColumn("_side", F.explode(F.array(side("away"), side("home")))).select("*", "_side.*").filter("score IS NOT NULL")
    both = sequence.score_changes(sides, [*KEY, "team"], ORDER, "score", F.col("read"), "t", ~F.col("live"), keep=["period", "clock", "held", "conf", "score_away", "score_home"])
    notes = F.filter(
        F.array(
            F.when(F.col("hidden_between") >= 2, F.format_string("score appeared after %.0fs without a readable live bug", F.col("t") - F.col("t_prev"))),
            F.when(F.col("points") > sport.most_points, F.format_string("score jumped by %d; more than one play may be merged", F.col("points"))),
        ),
        lambda x: x.isNotNull(),
    )
    return sequence.numbered(both.withColumn("notes", notes), KEY, ["t", "team"], "event_index")


def window_start(events: DataFrame, follow: str, step: float) -> DataFrame:
    """Where the biggest run begins: strictly after the other side's score that set the largest deficit."""
    own, other = ("score_home", "score_away") if follow == "home" else ("score_away", "score_home")
    theirs = events.filter(F.col("team") != follow)
    low = summaries.largest_deficit(theirs, KEY, own, other, ["t"], ["t", "period", "clock"])
    return low.withColumn("t_min", F.col("t") + step / 2)


def labelled(clips_: DataFrame, matches: DataFrame, plays: DataFrame) -> DataFrame:
    """Clips with scorers and descriptions of the plays that their changes matched; unmatched ones are less sure."""
    changes = clips_.select(*KEY, "clip", F.explode("changes").alias("change_id"))
    ids = changes.join(matches, [*KEY, "change_id"]).select(*KEY, "clip", "change_id", "how", "clock_diff", F.posexplode("play_ids").alias("at", "play_id"))
    named = ids.join(plays.select(*KEY, "play_id", "scorer", "description"), [*KEY, "play_id"])
    texts = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("change_id", "at", c))), lambda x: x[c])
    per = named.groupBy(*KEY, "clip").agg(
        F.array_join(F.array_distinct(texts("scorer")), " / ").alias("scorer"), F.array_join(texts("description"), " + ").alias("description"),
        F.max("how").alias("how"), F.max("clock_diff").alias("clock_diff"),
    )
    late = (F.col("how") == "score") & F.col("clock_diff").isNotNull()
    # a clip of a defensive play has no change to match
    factor = F.when(F.col("changes").isNull(), 1.0).when(F.col("how").isNull(), 0.75).when(late, 0.9).otherwise(1.0)
    return clips_.join(per, [*KEY, "clip"], "left").withColumn("confidence", F.round(F.col("confidence") * factor, 3))


def title(scorer: Column, points: Column, period: Column, clock: Column, away: Column, home: Column, sport: Sport) -> Column:
    """'Q3 9:40 · J. Brunson +3 · 55-81'."""
    when = F.trim(F.concat_ws(" ", period_name(sport, period), parse.clock_label(clock)))
    play = F.concat_ws(" ", F.nullif(scorer, F.lit("")), F.when(points > 0, F.concat(F.lit("+"), points.cast("string"))))
    score = F.when(away.isNotNull() & home.isNotNull(), F.concat_ws("-", away.cast("string"), home.cast("string")))
    return F.concat_ws(" · ", F.nullif(when, F.lit("")), F.nullif(play, F.lit("")), score)
