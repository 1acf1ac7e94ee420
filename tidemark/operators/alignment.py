"""Joins of ordered rows: as-of lookups, score chains, and greedy matching in passes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import folds


def asof(left: DataFrame, right: DataFrame, key: list[str], at: str, take: list[str], forward: bool = False, within: float | None = None, tie: str | None = None) -> DataFrame:
    """Left rows with the last right row at or before them (or the first at or after, if ``forward``).

    Both sides go through one sort by union; a window carries the nearest right row. No range
    join, so an entity with many rows costs n log n. Rows beyond ``within`` seconds are NULL.
    Of right rows at one time the last by ``tie`` counts (the first, if forward).
    """
    kept = F.struct(F.col(at).alias("_t"), *take)
    rows = left.withColumn("_side", F.lit(0)).withColumn("_hit", F.lit(None).cast(right.select(kept.alias("x")).schema["x"].dataType)).withColumn("_tie", F.lit(None).cast("string"))
    other = right.select(*key, F.col(at), F.lit(1).alias("_side"), kept.alias("_hit"), (F.col(tie) if tie else F.lit(0)).cast("string").alias("_tie"))
    both = rows.unionByName(other, allowMissingColumns=True)
    side = F.col("_side").desc() if not forward else F.col("_side").asc()
    w = Window.partitionBy(*key).orderBy(at, side, "_tie")
    if forward:
        hit = F.first("_hit", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    else:
        hit = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_found", hit).filter("_side = 0")
    if within is not None:
        found = found.withColumn("_found", F.when(F.abs(F.col(at) - F.col("_found._t")) <= within, F.col("_found")))
    return found.select(*left.columns, F.col("_found._t").alias("match_t"), *(F.col(f"_found.{c}").alias(f"match_{c}") for c in take))


def chain_lookup(changes: DataFrame, plays: DataFrame, key: list[str]) -> DataFrame:
    """Changes (before, after, points) with the plays that lead from one score to the other, where their points add up."""
    steps = changes.filter("before < after").withColumn("score", F.explode(F.sequence(F.col("before") + 1, F.col("after"))))
    hit = steps.join(plays.withColumnRenamed("points", "play_points"), [*key, "score"])
    per = hit.groupBy(*key, *[c for c in changes.columns if c not in key]).agg(F.sum("play_points").alias("_sum"), F.array_sort(F.collect_list(F.struct("score", "play_id"))).alias("_plays"))
    return per.filter(F.col("_sum") == F.col("points")).withColumn("plays", F.transform("_plays", lambda p: p["play_id"])).drop("_sum", "_plays")


def same_code_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose codes name the same team.

    Two codes of two letters or more agree in these, so they are the key; a code of one letter meets by that letter alone.
    """
    from tidemark.functions.parse import same_code

    start = lambda c, n: F.substring(F.upper(F.trim(F.col(c))), 1, n)
    x, y = left.withColumn("_two", start(a, 2)), right.withColumn("_two", start(b, 2))
    fits = same_code(F.col(a), F.col(b))
    short = lambda df: df.filter(F.length("_two") == 1)
    long_ = lambda df: df.filter(F.length("_two") == 2)
    by_letter = lambda df, c: df.withColumn("_one", start(c, 1)).drop("_two")
    parts = [
        long_(x).join(long_(y), "_two").drop("_two"),
        by_letter(short(x), a).join(by_letter(y.filter("_two <> ''"), b), "_one").drop("_one"),
        by_letter(long_(x), a).join(by_letter(short(y), b), "_one").drop("_one"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(fits)


def first_source(rows: DataFrame, key: list[str], priority: str) -> DataFrame:
    """The rows of each entity's best source that has any."""
    best = F.min(priority).over(Window.partitionBy(*key))
    return rows.withColumn("_best", best).filter(F.col(priority) == F.col("_best")).drop("_best")


def same_period(change: Column, play: Column) -> Column:
    """An unknown period of a change agrees with any."""
    return F.coalesce(change == play, change.isNull())


def chain_candidates(changes: DataFrame, plays: DataFrame, key: list[str], tolerance: float, late: float) -> DataFrame:
    """Changes with the plays of all scores they pass through, if these add up; ``turn`` 1 where the clock agrees, 3 where it may."""
    at_score = plays.filter("score IS NOT NULL").groupBy(*key, "score").agg(F.max(F.struct("play_id", F.col("points").alias("worth"), F.col("period").alias("in_period"), F.col("clock").alias("at_clock"))).alias("p"))
    steps = changes.filter("before < after").withColumn("score", F.explode(F.sequence(F.col("before") + 1, F.col("after"))))
    whole = steps.join(at_score, [*key, "score"]).groupBy(*key, "change_id").agg(
        F.max("points").alias("points"), F.max("period").alias("period"), F.max("clock").alias("clock"), F.sum("p.worth").alias("worth"),
        F.array_sort(F.collect_list(F.struct("score", "p.play_id"))).alias("way"), F.max(F.struct("score", "p.in_period", "p.at_clock")).alias("end"),
    )
    diff = F.abs(F.col("clock") - F.col("end.at_clock"))
    return (
        whole.filter((F.col("worth") == F.col("points")) & same_period(F.col("period"), F.col("end.in_period")))
        .withColumn("diff", diff)
        .filter(F.coalesce(F.col("diff") <= late, F.lit(True)))
        .select(*key, "change_id", F.when(F.col("diff") <= tolerance, 1).otherwise(3).alias("turn"), F.transform("way", lambda w: w["play_id"]).alias("play_ids"), "diff")
    )


def clock_candidates(changes: DataFrame, plays: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Changes with each play of as many points whose clock is near; neighbours meet in bins of the clock, not all with all."""
    near = tolerance + 1e-6
    bin_ = lambda c: F.floor(F.col(c) / near).cast("long")
    c = changes.filter("clock IS NOT NULL").withColumn("bin", F.explode(F.array(*(bin_("clock") + k for k in (-1, 0, 1)))))
    p = plays.filter("clock IS NOT NULL").select(*key, "points", F.col("play_id"), F.col("period").alias("in_period"), F.col("clock").alias("at_clock"), bin_("clock").alias("bin"))
    diff = F.abs(F.col("clock") - F.col("at_clock"))
    met = c.join(p, [*key, "points", "bin"]).filter(same_period(F.col("period"), F.col("in_period")) & (diff <= near))
    return met.select(*key, "change_id", F.lit(2).alias("turn"), F.array("play_id").alias("play_ids"), diff.alias("diff"))


def first_come(candidates: DataFrame, key: list[str], order: list[Column], owner: str, wanted: str) -> DataFrame:
    """Candidates in order within their entity, each taken if its owner has none yet and nothing it wants is taken.

    Whether one is taken hangs on all before it, so an entity's candidates (a few for each owner) are gone through in order.
    """

    def run(rows: pa.Table, each: list[folds.Entity]) -> pa.Table:
        owners_, wanted_ = rows[owner].to_pylist(), rows[wanted].to_pylist()
        keep, at = [], 0
        for size in map(len, each):
            owners, gone = set(), set()
            for who, what in zip(owners_[at : at + size], wanted_[at : at + size], strict=True):
                free = who not in owners and gone.isdisjoint(what)
                keep.append(free)
                if free:
                    owners.add(who)
                    gone.update(what)
            at += size
        return rows.filter(pa.array(keep, pa.bool_()))

    return folds.by_entity(candidates, key, order, candidates.schema, run)


def greedy_match(changes: DataFrame, plays: DataFrame, key: list[str], tolerance: float = 3.0, late: float = 30.0) -> DataFrame:
    """Changes matched to plays within each entity, each play once; unmatched ones are left out.

    In turn: score chain, period and clock agree; period and points agree and the clock is the
    nearest (the last play of equals); score chain and period agree, the clock is unknown or within
    ``late``. All that could match comes from joins; only who takes what is decided in order.
    """
    found = chain_candidates(changes, plays, key, tolerance, late).unionByName(clock_candidates(changes, plays, key, tolerance))
    order = [F.col("turn"), F.col("change_id"), F.col("diff"), F.col("play_ids")[0].desc()]
    taken = first_come(found, key, order, "change_id", "play_ids")
    how = F.when(F.size("play_ids") > 1, "merged").when(F.col("turn") == 3, "score").otherwise("clock")
    return taken.select(*key, "change_id", "play_ids", how.alias("how"), F.col("diff").alias("clock_diff"))


def match_summary(matches: DataFrame, changes: DataFrame, plays: DataFrame, key: list[str]) -> DataFrame:
    used = matches.select(*key, F.explode("play_ids").alias("play_id"))
    m = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("how") == "clock").alias("by_clock"))
    c = changes.join(matches.select(*key, "change_id"), [*key, "change_id"], "left_anti").groupBy(*key).agg(F.count(F.lit(1)).alias("unmatched_changes"))
    p = plays.join(used, [*key, "play_id"], "left_anti").groupBy(*key).agg(F.count(F.lit(1)).alias("unmatched_plays"))
    out = m.join(c, key, "full").join(p, key, "full")
    return out.na.fill(0, ["matched", "by_clock", "unmatched_changes", "unmatched_plays"])


def carried_edits(clips: DataFrame, edits: DataFrame, key: Column, edit_key: Column, take: list[str]) -> DataFrame:
    """Clips with the edits made earlier on the same play; rows of edits that found no clip have a NULL clip."""
    c = clips.withColumn("_key", key)
    e = edits.withColumn("_key", edit_key).select("_key", *(F.col(t).alias(f"edit_{t}") for t in take))
    return c.join(e, "_key", "full").drop("_key")


def play_key(play_id: Column, *rest: Column) -> Column:
    """What names a play in two analyses: its id in the feed, else where and what it was."""
    return F.when(play_id.isNotNull(), F.concat(F.lit("play|"), play_id.cast("string"))).otherwise(F.concat_ws("|", F.lit("seen"), *(F.coalesce(c.cast("string"), F.lit("?")) for c in rest)))


def best_overlap(boxes: DataFrame, others: DataFrame, key: list[str], least: float = 0.3) -> DataFrame:
    """Boxes (id, box) with the other of their frame that shares most of the smaller area; each is given once, the largest shares first."""
    from tidemark.functions.geometry import area, common

    pairs = boxes.join(others.select(*key, F.col("id").alias("other_id"), F.col("box").alias("other")), key)
    share = common(F.col("box"), F.col("other")) / F.greatest(F.least(area(F.col("box")), area(F.col("other"))), F.lit(1e-12))
    found = pairs.withColumn("share", share).filter(F.col("share") >= least).select(*key, "id", "other_id", "share", F.array("other_id").alias("_wanted"))
    return first_come(found, key, [F.desc("share"), F.col("id"), F.col("other_id")], "id", "_wanted").drop("_wanted")
