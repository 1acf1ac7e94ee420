"""Rules that turn score changes into clips: countdown resets, makes, starts, follow-ups, totals and the closing fold.

Lookups into other rows are unions with one window; nothing pairs all rows of an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import intervals
from tidemark.operators.alignment import asof

FREE = "free_throws"


def resets(known: DataFrame, key: list[str], value: str, at: str, index: str, targets: tuple[float, ...], ahead: int, correct: float = 1.5) -> DataFrame:
    """Jumps up of a countdown that are resets: ``reset_to`` and ``reset_at``.

    known: the rows with a reading. A jump of one or more counts if it lands on a target and the
    next reading (at most ``ahead`` rows on) continues from it; if an operator corrects it to a lower target
    within ``correct`` seconds; or if it shows one less than a target and two readings continue.
    Without targets any jump that continues counts, and so does one that nothing follows.
    """
    w = Window.partitionBy(*key).orderBy(index)
    reading = F.struct(F.col(value).alias("v"), F.col(at).alias("t"), F.col(index).alias("i"))
    later = lambda k: F.when(F.lead(index, k).over(w) - F.col(index) <= ahead, F.lead(reading, k).over(w))
    rows = known.withColumn("_was", F.lag(value).over(w)).withColumn("_one", later(1)).withColumn("_two", later(2)).filter(F.col(value) >= F.col("_was") + 1.0)
    near = lambda v, back=0.0: F.exists(F.array(*map(F.lit, targets)), lambda r: F.abs(v - (r - back)) < 0.01) if targets else F.lit(False)
    goes_on = lambda c: F.coalesce(F.col(f"{c}.v").between(F.col(value) - (F.col(f"{c}.t") - F.col(at)) - 1.0, F.col(value)), F.lit(False))
    plain = F.col("_one").isNull() | goes_on("_one")
    lower = (F.col("_one.v") > F.col("_was")) & (F.col("_one.v") < F.col(value)) & near(F.col("_one.v")) & (F.col("_one.t") - F.col(at) <= correct)
    passed = (F.col(value) >= F.col("_was") + 2.0) & goes_on("_one") & goes_on("_two") & (F.col("_two.v") <= F.col("_one.v")) & near(F.col(value), 1.0)
    here = lambda v: F.struct(v.alias("to"), F.col(at).alias("at"))
    exact = near(F.col(value)) if targets else F.lit(True)
    found = F.when(exact & plain, here(F.col(value))).when(exact & lower, F.struct(F.col("_one.v").alias("to"), F.col("_one.t").alias("at"))).when(~exact & passed, here(F.col(value) + 1.0))
    return rows.withColumn("_r", found).filter("_r IS NOT NULL").select(*known.columns, F.col("_r.to").alias("reset_to"), F.col("_r.at").alias("reset_at"))


def gap_before(changes: DataFrame, breaks: DataFrame, key: list[str], step: float) -> DataFrame:
    """Changes (t_prev, t) with the first break [a, b) of two steps or more that lies between, as gap_a and gap_b.

    Breaks of an entity are disjoint, so the first that starts late enough is the only one to ask.
    """
    long_ = breaks.filter(F.col("b") - F.col("a") >= 2 * step).select(*key, F.col("a").alias("_at"), "b")
    found = asof(changes.withColumn("_at", F.col("t_prev") - step), long_, key, "_at", ["b"], forward=True)
    fits = F.col("match_b") <= F.col("t") + step
    return found.withColumn("gap_a", F.when(fits, F.col("match_t"))).withColumn("gap_b", F.when(fits, F.col("match_b"))).drop("_at", "match_t", "match_b")


def make_times(changes: DataFrame, resets_: DataFrame, stops: DataFrame, key: list[str], lag: float = 4.5, held: float = 8.0) -> DataFrame:
    """Changes (t, anchored) with ``made``: when the score was really made.

    That is the last reset (t, t_start) before, if at most ``lag`` old or, with its countdown not
    yet running, ``held``; else the last stop (t) of the game clock within ``lag``. A change
    anchored at a break has only a reset that hadn't begun to run.
    """
    reset = asof(changes, resets_, key, "t", ["t_start"]).withColumnRenamed("match_t", "_reset")
    both = asof(reset, stops, key, "t", [], within=lag).withColumnRenamed("match_t", "_stop")
    age, start = F.col("t") - F.col("_reset"), F.col("match_t_start")
    running = (age <= lag) | ((start >= F.col("t") - 1.0) & (age <= held))
    seen = F.when(F.col("anchored"), (age <= lag) & (start >= F.col("t") - 0.5)).otherwise(running)
    return both.withColumn("made", F.when(seen, F.col("_reset")).when(~F.col("anchored"), F.col("_stop"))).drop("_reset", "_stop", "match_t_start")


def last_starts(changes: DataFrame, signs: DataFrame, key: list[str], causes: list[str], most: float) -> DataFrame:
    """Changes (t, team, limit) with ``start`` and ``cause``: of each cause's last sign by ``limit``, the one with the latest start.

    signs: at, start, cause; those without a start end the search for their cause. The causes
    ``home`` and ``away`` are scores of these sides and become own_score and opponent_score. Of
    equal starts the last cause by name counts. Without any, or too old, it is ``most`` before.
    """
    asked = changes.withColumn("_c", F.struct(*[c for c in changes.columns if c not in key])).select(*key, F.col("limit").alias("_at"), F.lit(1).alias("_ask"), "_c")
    both = asked.unionByName(signs.select(*key, F.col("at").alias("_at"), F.lit(0).alias("_ask"), F.struct("start", "cause").alias("_s")), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_at", "_ask", "_s.start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when(F.col("_s.cause") == c, F.col("_s")), ignorenulls=True).over(w) for c in causes]
    found = both.withColumn("_l", F.array(*last)).filter("_ask = 1").select(*key, "_c.*", "_l")
    name = lambda c: F.when(c.isin("home", "away"), F.when(c == F.col("team"), "own_score").otherwise("opponent_score")).otherwise(c)
    best = F.array_max(F.transform(F.filter("_l", lambda s: s["start"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), name(s["cause"]).alias("cause"))))
    out = found.withColumn("_b", best).drop("_l")
    fits = F.coalesce(F.col("t") - F.col("_b.start") <= most + 10, F.lit(False))
    return out.withColumn("start", F.when(fits, F.col("_b.start")).otherwise(F.col("t") - most)).withColumn("cause", F.when(fits, F.col("_b.cause")).otherwise("max_length")).drop("_b")


def clip_end(t: Column, made: Column, roll: float, hold: float = 0.5, tail: float = 2.5) -> Column:
    """``roll`` after the score shows, or earlier where the make is known."""
    return F.when(made.isNull(), t + roll).otherwise(F.least(t + roll, F.greatest(t + hold, made + tail)))


def bounded(start: Column, end: Column, cause: Column, least: float, most: float) -> Column:
    """Struct a, b, cause, trimmed of a span kept between the least and the greatest length."""
    late = start > end - 1.0
    from_ = F.when(late, end - least).otherwise(start)
    why = F.when(late, "min_length").otherwise(cause)
    trimmed = end - from_ > most
    a = F.when(trimmed, end - most).when(end - from_ < least, end - least).otherwise(from_)
    return F.struct(a.alias("a"), end.alias("b"), F.when(trimmed & (why != "max_length"), F.concat(why, F.lit("+trimmed"))).otherwise(why).alias("cause"), trimmed.alias("trimmed"))


def followed(events: DataFrame, key: list[str], within: float = 120.0, dead_ball: float = 75.0, stopped_least: float = 3.0, try_window: float = 90.0) -> DataFrame:
    """Score changes with ``clip`` (the change whose clip they belong to) and ``role``.

    events: event_index, t, team, kind, points, period, clock, held_clock, stopped, stopped_for.
    A change hangs on the one right before it, by the same team: one or two points after a touchdown
    with the clock left there (``tail``); a free throw after a basket (``and_one``) or after
    another free throw (``more``) in one stoppage. Chains follow the first, whose role is NULL.
    """
    w = Window.partitionBy(*key).orderBy("event_index")
    cols = ("t", "team", "kind", "points", "period", "clock", "held_clock")
    prev = lambda c: F.col(f"_p.{c}")
    rows = events.withColumn("_p", F.lag(F.struct(*cols)).over(w))
    since = F.col("t") - prev("t")
    own = prev("team") == F.col("team")
    same = lambda tol: F.col("period").eqNullSafe(prev("period")) & (F.abs(F.col("held_clock") - prev("held_clock")) <= tol) & since.between(0, dead_ball)
    clock_kept = F.coalesce(F.abs(prev("clock") - F.col("clock")) <= 1.0, since.between(0, try_window))
    tail = own & (prev("kind") == "touchdown") & F.col("points").isin(1, 2) & F.coalesce(prev("period") == F.col("period"), F.lit(True)) & clock_kept
    free = own & (F.col("kind") == FREE)
    and_one = free & (prev("kind") != FREE) & (since <= within) & (F.col("stopped") | (F.col("stopped_for") >= stopped_least)) & same(1.05)
    role = F.when(tail, "tail").when(and_one, "and_one").when(free & (prev("kind") == FREE) & same(0.05), "more")
    head = F.last(F.when(F.col("role").isNull(), F.col("event_index")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("role", role).withColumn("clip", head).drop("_p")


def chosen(rows: DataFrame, key: list[str], selected: Column, tail: bool = True, and_one: bool = True, free_throws: bool = True) -> DataFrame:
    """Rows of ``followed`` that the options and ``selected`` let in; follow-ups go with a first that doesn't come in."""
    w = Window.partitionBy(*key, "clip")
    head_kind = F.max(F.when(F.col("role").isNull(), F.col("kind"))).over(w)
    head_in = F.max(F.when(F.col("role").isNull(), selected)).over(w)
    wanted = F.when(F.col("role") == "tail", F.lit(tail)).when((F.col("kind") == FREE) & (F.col("_head") == FREE), F.lit(free_throws)).when(F.col("kind") == FREE, F.lit(and_one)).otherwise(F.lit(True))
    return rows.withColumn("_head", head_kind).withColumn("_in", head_in & selected).filter(F.col("_in") & wanted).drop("_head", "_in")


def settle(segments: DataFrame, key: list[str], least: float = 0.4) -> DataFrame:
    """Segments (clip, team, a, b) of clips after the closing fold, with ``into``: the clip they are part of now.

    Clips go in order of their starts. One that begins before the last one's end joins it if the team is
    the same; of another team it begins at that end, and goes if its first segment is then shorter than
    ``least``. The state is one clip, so the fold is an aggregate over the entity's clips.
    """
    first = F.min(F.struct("a", "b"))
    clips = segments.groupBy(*key, "clip", "team").agg(first.alias("_f"), F.max("b").alias("_end"))
    per = clips.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("_f.a").alias("a"), "clip", F.col("_f.b").alias("b"), F.col("_end").alias("end"), "team"))).alias("_clips"))
    kind = clips.schema["clip"].dataType.simpleString()
    out = F.array().cast(f"array<struct<clip:{kind},into:{kind},cut:double>>")
    start = F.struct(F.lit(None).cast("string").alias("team"), F.lit(None).cast("double").alias("end"), F.lit(None).cast(kind).alias("into"), out.alias("out"))

    def step(s: Column, r: Column) -> Column:
        over = F.coalesce(r["a"] <= s["end"], F.lit(False))
        joins = over & (r["team"] == s["team"])
        cut = over & ~joins
        gone = cut & (r["b"] - s["end"] < least)
        into = F.when(joins, s["into"]).otherwise(r["clip"])
        row = F.struct(r["clip"].alias("clip"), into.alias("into"), F.when(cut, s["end"]).alias("cut"))
        return F.struct(
            F.when(gone, s["team"]).otherwise(r["team"]).alias("team"), F.when(gone, s["end"]).when(joins, F.greatest(s["end"], r["end"])).otherwise(r["end"]).alias("end"),
            F.when(gone, s["into"]).otherwise(into).alias("into"), F.when(gone, s["out"]).otherwise(F.concat(s["out"], F.array(row))).alias("out"),
        )

    folded = per.select(*key, F.explode(F.aggregate("_clips", start, step, lambda s: s["out"])).alias("_o")).select(*key, "_o.*")
    # a cut moves the first segment's start only
    return segments.join(folded, [*key, "clip"]).withColumn("a", F.when(F.col("cut").isNotNull(), F.greatest("a", "cut")).otherwise(F.col("a"))).filter("b > a").drop("cut")


def totals(changes: DataFrame, key: list[str], clip: str) -> DataFrame:
    """Points of each clip, with period, clock and score at its first change and the score after its last."""
    by = F.struct("t", "event_index")
    first, last = F.min_by(F.struct("period", "clock", "before"), by), F.max_by(F.struct("after", "score_away", "score_home"), by)
    return changes.groupBy(*key, clip).agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("n_changes"), first.alias("_f"), last.alias("_l")).select(
        *key, clip, "points", "n_changes", F.col("_f.period").alias("period"), F.col("_f.clock").alias("clock"), F.col("_f.before").alias("score_before"),
        F.col("_l.after").alias("score_after"), F.col("_l.score_away").alias("score_away"), F.col("_l.score_home").alias("score_home"),
    )


def typical_lag(changes: DataFrame, resets_: DataFrame, key: list[str], lag: float = 4.5, enough: int = 4) -> DataFrame:
    """The median time from a make's reset to its score, for entities with ``enough`` of them."""
    found = asof(changes.select(*key, "t"), resets_.select(*key, "t"), key, "t", [], within=lag).filter("match_t IS NOT NULL")
    return found.groupBy(*key).agg(F.median(F.col("t") - F.col("match_t")).alias("lag"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= enough).drop("_n")


def free_throw_window(lag: Column, lead: float = 2.0, tail: float = 2.0, hold: float = 0.5, assumed: float = 1.0) -> tuple[Column, Column]:
    """Seconds shown before and after a free throw appears, by the display's usual lag."""
    known = F.coalesce(lag, F.lit(assumed))
    return known + lead, F.least(F.lit(1.0), F.greatest(F.lit(hold), tail - known))


def side_of(team: Column, plays: tuple[Column, Column], game: tuple[Column, Column], read: tuple[Column, Column]) -> Column:
    """'away' or 'home' for a wished team: said so, by the plays' codes, by the game's, by codes read off the display, else home.

    Pairs are (away, home).
    """
    wish = F.trim(F.coalesce(team, F.lit("")))
    equal = lambda c: (wish != "") & (F.upper(F.coalesce(c, F.lit(""))) == F.upper(wish))
    alike = lambda c: (wish != "") & parse.same_code(F.coalesce(c, F.lit("")), wish)
    said = F.when(F.lower(wish).isin("away", "home"), F.lower(wish))
    asked = [F.when(equal(away), "away").when(equal(home), "home") for away, home in (plays, game)]
    return F.coalesce(said, *asked, F.when(alike(read[0]), "away").when(alike(read[1]), "home"), F.lit("home"))


def cleared(segments: DataFrame, breaks: DataFrame, key: list[str], duration: DataFrame, least: float = 0.4) -> DataFrame:
    """Segments of clips joined, without breaks, inside the entity's ``duration``, without short ones."""
    per = [*key, "clip", "team"]
    joined = intervals.merge(segments, per)
    # a break is asked for by the clips whose whole reach it touches
    reach = joined.groupBy(*per).agg(F.min("a").alias("_a"), F.max("b").alias("_b"))
    holes = breaks.select(*key, "a", "b").join(reach, key).filter((F.col("a") < F.col("_b")) & (F.col("b") > F.col("_a"))).select(*per, "a", "b")
    inside = intervals.subtract(joined, holes, per).join(duration, key)
    return intervals.long_enough(intervals.clamp(inside, F.lit(0.0), F.col("duration")), least).drop("duration")
