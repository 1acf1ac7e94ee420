"""Operators over ordered rows of an entity: window expressions, no Python.

Every function takes the entity key(s), the order columns and column names, and keeps all rows
of one entity in one window partition, so entities run in parallel. Unknown values are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def over(key: Names, order: Names):
    return Window.partitionBy(*key).orderBy(*order)


def lately(agg: str, key: Names, at: str, reach: float) -> Column:
    """An aggregate (SQL text) over the rows of the last ``reach`` seconds; range frames on doubles are stated in SQL."""
    return F.expr(f"{agg} OVER (PARTITION BY {', '.join(key)} ORDER BY {at} RANGE BETWEEN {float(reach)!r}D PRECEDING AND CURRENT ROW)")


def numbered(df: DataFrame, key: Names, order: Names, name: str = "i") -> DataFrame:
    """Dense index from 0 in order."""
    return df.withColumn(name, F.row_number().over(over(key, order)) - 1)


def forward_fill(df: DataFrame, key: Names, order: Names, value: str, out: str, head: bool = False) -> DataFrame:
    """Last known value so far; with ``head``, rows before the first known one take it."""
    w = over(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.last(value, ignorenulls=True).over(w)
    if head:
        whole = over(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        filled = F.coalesce(filled, F.first(value, ignorenulls=True).over(whole))
    return df.withColumn(out, filled)


def interpolate(df: DataFrame, key: Names, order: Names, at: str, value: str, out: str, limit: float, same: str | None = None) -> DataFrame:
    """Linear values between neighbouring known ones at most ``limit`` apart (and equal in ``same``)."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v"), (F.col(same) if same else F.lit(0)).alias("s")))
    w = over(key, order)
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(point, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    shown = df.withColumn("_before", before).withColumn("_after", after)
    span = F.col("_after.t") - F.col("_before.t")
    line = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * ((F.col(at) - F.col("_before.t")) / span)
    ok = (span > 0) & (span <= limit) & (F.col("_before.s") == F.col("_after.s"))
    return shown.withColumn(out, F.coalesce(F.col(value), F.when(ok, line))).drop("_before", "_after")


def nearest_known(df: DataFrame, key: Names, order: Names, value: str, out: str, reach: int, index: str = "i") -> DataFrame:
    """The known value fewest rows away, at most ``reach``; the earlier one of two equally near."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("at"), F.col(value).alias("v")))
    w = over(key, order)
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(-reach, 0))
    after = F.first(point, ignorenulls=True).over(w.rowsBetween(0, reach))
    back, ahead = F.col(index) - F.col("_before.at"), F.col("_after.at") - F.col(index)
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("_before.v")).otherwise(F.col("_after.v"))
    return df.withColumn("_before", before).withColumn("_after", after).withColumn(out, pick).drop("_before", "_after")


def gap_runs(df: DataFrame, key: Names, index: str, at: str, max_gap: int = 1) -> DataFrame:
    """Runs of the given rows with at most ``max_gap`` missing indexes inside: first, last, rows, times."""
    w = over(key, [index])
    new = F.coalesce((F.col(index) - F.lag(index).over(w) > max_gap + 1).cast("int"), F.lit(1))
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        df.withColumn("_new", new).withColumn("_run", run).groupBy(*key, "_run")
        .agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"), F.min(at).alias("t_first"), F.max(at).alias("t_last"))
        .drop("_run")
    )


def runs(df: DataFrame, key: Names, order: Names, value: str, index: str = "i", at: str = "t") -> DataFrame:
    """Run-length encoding of equal neighbouring values: value, first, last, n, t_first, t_last."""
    w = over(key, order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(index).over(w).isNull()).cast("int")
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        df.withColumn("_new", new).withColumn("_run", run).groupBy(*key, "_run")
        .agg(F.first(value).alias("value"), F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"), F.min(at).alias("t_first"), F.max(at).alias("t_last"))
        .drop("_run")
    )


def widened(df: DataFrame, key: Names, order: Names, on: Column, at: str, step: float, index: str = "i") -> DataFrame:
    """Maximal runs where ``on`` is false, widened to the neighbouring rows' times (``step`` at the ends)."""
    w = over(key, order)
    marked = df.withColumn("_on", on).withColumn("_lo", F.coalesce(F.lag(at).over(w), F.col(at) - step)).withColumn("_hi", F.coalesce(F.lead(at).over(w), F.col(at) + step))
    run = F.sum((F.col("_on") | F.coalesce(F.lag("_on").over(w), F.lit(True))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_run", run).filter(~F.col("_on")).groupBy(*key, "_run").agg(F.min("_lo").alias("a"), F.max("_hi").alias("b")).drop("_run")


def held_changes(df: DataFrame, key: Names, order: Names, value: str, hold: int = 2, index: str = "i", at: str = "t") -> DataFrame:
    """Changes to a value that lasts ``hold`` rows: t, old, new. The first such value is only the start."""
    lasting = runs(df, key, order, value, index, at).filter(F.col("value").isNotNull() & (F.col("n") >= hold))
    old = F.lag("value").over(over(key, ["first"]))
    return lasting.withColumn("old", old).filter("old <> value").select(*key, F.col("first").alias(index), F.col("t_first").alias("t"), "old", F.col("value").alias("new"))


def increases(df: DataFrame, key: Names, order: Names, value: str) -> DataFrame:
    """Rows whose known value is above the previous known one, with that one as ``before``."""
    known = df.filter(F.col(value).isNotNull())
    return known.withColumn("before", F.lag(value).over(over(key, order))).filter(F.col(value) > F.col("before"))


def running(df: DataFrame, key: Names, order: Names, value: str, out: str, reach: int, least: float) -> DataFrame:
    """Whether a falling value moves: a higher one within ``reach`` rows before, or a lower one after."""
    w = over(key, order)
    before, after = F.max(value).over(w.rowsBetween(-reach, -1)), F.min(value).over(w.rowsBetween(1, reach))
    return df.withColumn(out, F.coalesce(before > F.col(value) + least, F.lit(False)) | F.coalesce(after < F.col(value) - least, F.lit(False)))


def held_for(df: DataFrame, key: Names, order: Names, value: str, at: str, out: str, reach: float, among: Column | None = None) -> DataFrame:
    """Seconds that the current value has been shown, looking back at most ``reach``; only rows ``among`` count, others get NULL."""
    w = over(key, order)
    own = F.lit(True) if among is None else among
    before = F.lag(value).over(w) if among is None else F.last(F.when(own, F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (own & ~F.col(value).eqNullSafe(before)).cast("int")
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    since = lately("min(_own)", [*key, "_run"], at, reach)
    marked = df.withColumn("_new", new).withColumn("_own", F.when(own, F.col(at))).withColumn("_run", run)
    return marked.withColumn(out, F.when(own, F.col(at) - since)).drop("_new", "_own", "_run")


def longest_hold_before(df: DataFrame, key: Names, at: str, held: str, value: str, reach: float, least: float) -> DataFrame:
    """The longest hold in the last ``reach`` seconds, and its value where it is at least ``least``; the latest of equals."""
    best = lately(f"max(struct({held} AS h, {at} AS t, {value} AS v))", key, at, reach)
    return df.withColumn("_best", best).withColumn("longest", F.col("_best.h")).withColumn("held_value", F.when(F.col("_best.h") >= least, F.col("_best.v"))).drop("_best")


def restarts(df: DataFrame, key: Names, order: Names, value: str, at: str, hold: float, within: float, index: str = "i") -> DataFrame:
    """Moments a value that was held at least ``hold`` seconds falls within ``within`` seconds."""
    found = runs(df, key, order, value, index, at)
    w = over(key, ["first"])
    nxt = found.withColumn("_next", F.lead(F.struct("value", F.col("t_first").alias("t"), F.col("first").alias("at"))).over(w))
    ok = (F.col("t_last") - F.col("t_first") >= hold) & (F.col("_next.value") < F.col("value")) & (F.col("_next.t") - F.col("t_last") <= within)
    return nxt.filter(ok).select(*key, F.col("_next.at").alias(index), F.col("_next.t").alias("t"), (F.col("t_last") - F.col("t_first")).alias("stopped_for"))


def clock_starts(df: DataFrame, key: Names, order: Names, clock: str, other: str, at: str, live: str, step: float, fresh: tuple[float, ...] = ()) -> DataFrame:
    """Moments ``at`` a stopped clock began to run, ``stopped_for`` seconds after it stopped, by its own first fall and that of ``other``.

    A clock has stopped if it held a value for 2.4 seconds, or 1.4 where the two seconds before weren't
    seen. The fall shows within 2.5 seconds, so the start lies between a whole step of the clock
    before it (a second, a tenth under a minute) and it. A second countdown that starts with it and falls
    within three seconds bounds it again: by the fall, less the second that one of the ``fresh``
    values stands. The moment is the middle of what both leave (fixed values).
    """
    w = over(key, order)
    known = F.col(live) & F.col(other).isNotNull()
    later = F.collect_list(F.when(known, F.struct(F.col(at).alias("t"), F.col(other).alias("v")))).over(w.rowsBetween(1, int(3 / step)))
    tick = F.try_element_at(F.filter(later, lambda x: x["v"] < F.col(other)), F.lit(1))["t"]
    rows = df.withColumn("_tick", F.when(known, F.struct(F.col(other).alias("v"), tick.alias("t")))).filter(F.col(live) & F.col(clock).isNotNull())
    new = F.coalesce((F.abs(F.col(clock) - F.lag(clock).over(w)) >= 0.05).cast("int"), F.lit(1))
    held = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs_ = held.groupBy(*key, "_run").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.min_by(clock, at).alias("first"), F.max_by(clock, at).alias("last"), F.max_by("_tick", at).alias("tick"))
    by = over(key, ["a"])
    seen = runs_.withColumn("_next", F.lead(F.struct("first", "a")).over(by)).withColumn("_gap", F.col("a") - F.lag("b").over(by))
    need = F.when(F.coalesce(F.col("_gap") > 2.0, F.lit(True)), 1.4).otherwise(2.4)
    went = seen.filter((F.col("b") - F.col("a") >= need) & (F.col("_next.first") < F.col("last")) & (F.col("_next.a") - F.col("b") <= 2.5))
    stands = F.col("tick.v").isin(*fresh) if fresh else F.lit(False)
    upper = F.least("_next.a", F.col("tick.t") - F.when(stands, 1.0).otherwise(0.0))
    lower = F.greatest(F.col("_next.a") - step - F.when(F.col("last") < 60.0, 0.1).otherwise(1.0), F.col("tick.t") - step - 1.0)
    middle = F.when(lower < upper, (lower + upper) / 2).otherwise(upper - 0.5)
    return went.select(*key, F.greatest(middle, "b").alias("at"), (F.col("b") - F.col("a")).alias("stopped_for"))


def upward_jumps(df: DataFrame, key: Names, order: Names, value: str, at: str, least: float, reach: float) -> DataFrame:
    """Jumps of at least ``least`` over the last known value, with the first later fall within ``reach`` seconds."""
    w = over(key, order)
    known = df.filter(F.col(value).isNotNull())
    falls = F.when(F.lead(value).over(w) < F.col(value), F.lead(at).over(w))
    moved = known.withColumn("before", F.lag(value).over(w)).withColumn("_fall", falls)
    first_fall = F.first("_fall", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    jumped = moved.withColumn("fall_at", first_fall).filter(F.col(value) >= F.col("before") + least)
    return jumped.withColumn("fall_at", F.when(F.col("fall_at") - F.col(at) < reach, F.col("fall_at"))).drop("_fall")


def switched_off(df: DataFrame, key: Names, order: Names, value: str, n: int) -> DataFrame:
    """First rows of at least ``n`` unknown rows in a row that follow a known one."""
    w = over(key, order)
    ahead = F.max(F.col(value).isNotNull()).over(w.rowsBetween(0, n - 1))
    size = F.count(F.lit(1)).over(w.rowsBetween(0, n - 1))
    return df.withColumn("_any", ahead).withColumn("_n", size).withColumn("_prev", F.lag(value).over(w)).filter((F.col("_n") == n) & ~F.col("_any") & F.col("_prev").isNotNull()).drop("_any", "_n", "_prev")


def score_changes(df: DataFrame, key: Names, order: Names, score: str, read: Column, at: str, hidden: Column, index: str = "i", keep: Names = ()) -> DataFrame:
    """Increases of a score with the last row that read the old one and the hidden rows in between; ``keep``: more columns of the row."""
    w = over(key, order)
    marked = df.withColumn("_read", F.when(read, F.struct(F.col(index).alias("i"), F.col(at).alias("t")))).withColumn("_hid", F.sum(hidden.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.last("_read", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = marked.withColumn("before", F.lag(score).over(w)).withColumn("_last", F.coalesce(last, F.lag(F.struct(F.col(index).alias("i"), F.col(at).alias("t"))).over(w)))
    hid_at = F.lag("_hid").over(w)
    seen = seen.withColumn("_hid_before", hid_at)
    # hidden rows strictly between the last read and the change: by running counts looked up at both ends
    reads = F.last(F.when(read, F.col("_hid")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("_hid_read", reads).filter(F.col(score) > F.col("before"))
    return seen.select(*key, F.col(index), F.col(at).alias("t"), F.col("_last.t").alias("t_prev"), "before", F.col(score).alias("after"), (F.col(score) - F.col("before")).alias("points"), F.greatest(F.lit(0), F.col("_hid_before") - F.coalesce("_hid_read", F.lit(0))).alias("hidden_between"), *keep)
