"""What happens around a cut: lookups in game time, side checks, re-reads, filters, templates and captions."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.alignment import asof
from tidemark.sources.scratch import Scratch


def first_at(rows: DataFrame, targets: DataFrame, key: list[str], at: str, reached: str, target: str) -> DataFrame:
    """For each target the time of the first row whose ``reached`` is at least it.

    The running maximum of ``reached`` never falls, so the first row at or above a target is an
    as-of lookup on it.
    """
    top = F.max(reached).over(Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = rows.filter(F.col(reached).isNotNull()).withColumn("_top", top).groupBy(*key, "_top").agg(F.min(at).alias("first")).withColumnRenamed("_top", target)
    return asof(targets, steps, key, target, ["first"], forward=True).withColumnRenamed("match_first", "found_t").drop("match_t")


def unchanged_since(rows: DataFrame, key: list[str], at: str, value: str, seconds: float, most: float = 180.0) -> DataFrame:
    """Whether a row's value is that of the last known row at least ``seconds`` ago (and at most ``most``)."""
    known = rows.filter(F.col(value).isNotNull()).select(*key, F.col(at), F.col(value).alias("was"))
    asked = rows.withColumn("_now", F.col(at)).withColumn(at, F.col(at) - seconds)
    found = asof(asked, known, key, at, ["was"])
    same = (F.col("match_was") == F.col(value)) & (F.col("_now") - F.col("match_t") <= most)
    return found.withColumn(at, F.col("_now")).withColumn("unchanged", F.coalesce(same, F.lit(False))).drop("_now", "match_t", "match_was")


def last_onset(rows: DataFrame, runs: DataFrame, key: list[str], at: str, within: float) -> DataFrame:
    """The start of the last run (t_first) that began in the ``within`` seconds before each row."""
    starts = runs.select(*key, F.col("t_first").alias(at))
    return asof(rows, starts, key, at, [], within=within).withColumnRenamed("match_t", "onset")


def on_key_frames(rows: DataFrame, frames: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Value at each row's time between key frames (linear), held before the first and after the last."""
    nxt = F.lead(F.struct(F.col(at).alias("t"), F.col(value).alias("v"))).over(Window.partitionBy(*key).orderBy(at))
    back = asof(rows, frames.withColumn("nxt", nxt), key, at, [value, "nxt"])
    first = frames.groupBy(*key).agg(F.min_by(value, at).alias("_first"))
    part = (F.col(at) - F.col("match_t")) / (F.col("match_nxt.t") - F.col("match_t"))
    v = F.coalesce(F.col(f"match_{value}") + (F.col("match_nxt.v") - F.col(f"match_{value}")) * part, F.col(f"match_{value}"), F.col("_first"))
    return back.join(first, key, "left").withColumn("on_track", v).drop("match_t", f"match_{value}", "match_nxt", "_first")


def sides_reversed(finals: DataFrame) -> Column:
    """Finals (away, home) read against the game's own: reversed if only the swap agrees."""
    straight = (F.col("read_away") == F.col("away")) & (F.col("read_home") == F.col("home"))
    crossed = (F.col("read_away") == F.col("home")) & (F.col("read_home") == F.col("away"))
    return F.coalesce(crossed & ~straight, F.lit(False))


def swapped(df: DataFrame, when: Column, pairs: list[tuple[str, str]]) -> DataFrame:
    """Column pairs exchanged where ``when`` holds."""
    return df.withColumns({c: F.when(when, F.col(d)).otherwise(F.col(c)) for a, b in pairs for c, d in ((a, b), (b, a))})


def patched(samples: DataFrame, patch: DataFrame, key: list[str], good: Column, sure: float = 0.9, conf: float = 0.95) -> DataFrame:
    """Readings (text, conf) overwritten by re-reads that parse, where they differ or were not sure."""
    p = patch.select(*key, F.col("text").alias("_new"))
    joined = samples.join(p, key, "left")
    take = F.col("_new").isNotNull() & good & ((F.col("_new") != F.col("text")) | (F.col("conf") < F.lit(sure).cast("float")))
    return joined.withColumn("conf", F.when(take, F.lit(conf).cast("float")).otherwise(F.col("conf"))).withColumn("text", F.when(take, F.col("_new")).otherwise(F.col("text"))).drop("_new")


def worth_rereading(samples: DataFrame, changes: DataFrame, key: list[str], index: str, most: int, share: float = 0.25) -> DataFrame:
    """Unsure rows, those between a change and the last read before it first; none of an entity that is mostly unsure."""
    w = Window.partitionBy(*key)
    rate = F.avg(F.col("unsure").cast("double")).over(w)
    open_ = changes.filter(F.col("i") - F.col("i_prev") >= 3).select(*(F.col(k).alias(f"_{k}") for k in key), "i_prev", F.col("i").alias("i_to"))
    bad = samples.withColumn("_rate", rate).filter((F.col("_rate") <= share) & F.col("unsure"))
    near = bad.join(open_, [bad[k] == open_[f"_{k}"] for k in key] + [bad[index] > open_["i_prev"], bad[index] < open_["i_to"]], "left_semi").select(*key, index).withColumn("_near", F.lit(0))
    ranked = bad.join(near, [*key, index], "left").withColumn("rank", F.row_number().over(w.orderBy(F.coalesce("_near", F.lit(1)), index)))
    return ranked.filter(F.col("rank") <= most).drop("_rate", "_near")


def source_time(cuts: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """Where an offset into a concatenation lies in its source: the segment that holds it, the last one beyond the end."""
    from tidemark.operators.intervals import place_in_cut

    placed = place_in_cut(cuts, key, ["a"]).select(*key, F.col("out_start").alias("offset"), "a", "b")
    found = asof(asked, placed, key, "offset", ["a", "b"])
    return found.withColumn("source_t", F.least(F.col("match_a") + (F.col("offset") - F.col("match_t")), F.col("match_b"))).drop("match_t", "match_a", "match_b")


#: Templates of each entity that are asked first, how many times more in each further pass, and rows that may be broadcast.
FEW, MORE, SENT = 16, 4, 8192


def first_template(frames: DataFrame, templates: DataFrame, key: list[str], alike: Column, least_share: float = 0.2, least: int = 2) -> DataFrame:
    """The most recent template that is like enough of an entity's frames. Both carry ``shape``; only equal shapes are compared.

    Only the most recent counts, so templates are asked from the last one back, in passes that grow, and an
    entity leaves with the first that fits. A pass compares all frames of the entities still open with a bounded number of
    templates, which are sent to the frames. All pairs are compared only of an entity that none of its templates fits.
    """
    spark, scratch = frames.sparkSession, Scratch(frames.sparkSession, "templates")
    own = [f"_{k}" for k in key]
    rank = F.dense_rank().over(Window.partitionBy(*own).orderBy(F.desc("made_at"), "template_id"))
    asked = templates.join(frames.select(*(F.col(k).alias(o) for k, o in zip(key, own, strict=True)), "shape").distinct(), "shape").withColumn("_r", rank)
    # few entities may have very many frames: these are dealt row by row
    seen = scratch.write(frames.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "frames")
    same = lambda a, b: functools.reduce(Column.__and__, (a[k].eqNullSafe(b[o]) for k, o in zip(key, own, strict=True)))
    found, last, n = [], 0, FEW
    while True:
        first, last = last + 1, last + n
        here = scratch.write(asked.filter(F.col("_r").between(first, last)), f"asked{last}")
        sent = F.broadcast(here) if here.count() <= SENT else here
        pairs = seen.join(sent, (seen["shape"] == sent["shape"]) & same(seen, sent)).withColumn("_alike", alike.cast("int"))
        per = pairs.groupBy(*key, "template_id", "made_at").agg(F.sum("_alike").alias("n_alike"), F.count(F.lit(1)).alias("n"))
        ok = per.filter(F.col("n_alike") >= F.greatest(F.lit(least), F.ceil(F.col("n") * least_share)))
        r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("made_at"), "template_id"))
        found.append(scratch.write(ok.withColumn("_r", r).filter("_r = 1").drop("_r", "made_at"), f"found{last}"))
        # entities go on that have more templates than were asked, if none of those fits
        full = here.groupBy(*own).agg(F.max("_r").alias("_last")).filter(F.col("_last") == last).drop("_last")
        left = scratch.write(full.join(found[-1], same(found[-1], full), "left_anti"), f"left{last}")
        many = left.count()
        if not many:
            return functools.reduce(DataFrame.unionByName, found)
        goes_on = functools.reduce(Column.__and__, (asked[o].eqNullSafe(left[o]) for o in own))
        asked = asked.filter(F.col("_r") > last).join(left, goes_on, "left_semi")
        if first == 1:
            asked = scratch.write(asked, "asked")  # ranked once
        n = max(1, min(n * MORE, SENT // many))


def nearest_box(numbers: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """The label nearest to each number of a frame; a vertical distance counts twice. Frames hold few boxes."""
    pairs = numbers.join(labels.select(*key, F.col("id").alias("label_id"), F.col("x").alias("_x"), F.col("y").alias("_y")), key)
    d = F.abs(F.col("x") - F.col("_x")) + 2 * F.abs(F.col("y") - F.col("_y"))
    return pairs.groupBy(*key, "id").agg(F.min_by("label_id", F.struct(d, "label_id")).alias("label_id"), F.min(d).alias("distance"))


def cluster_boxes(boxes: DataFrame, key: list[str], least: float) -> DataFrame:
    """Clusters of boxes (id, x0..y1, split) in one frame: each joins the first cluster whose first box it overlaps by ``least`` (IoU).

    Exact boxes come before estimated ones; every join depends on those before, so a frame is one
    grouped map.
    """
    names = ["x0", "y0", "x1", "y1"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        heads: list[np.ndarray] = []
        out = []
        for r in rows.sort_values(["split", "id"]).itertuples():
            b = np.array([getattr(r, n) for n in names])
            for k, h in enumerate(heads):
                w, t = min(b[2], h[2]) - max(b[0], h[0]), min(b[3], h[3]) - max(b[1], h[1])
                both = max(w, 0) * max(t, 0)
                if both / max((b[2] - b[0]) * (b[3] - b[1]) + (h[2] - h[0]) * (h[3] - h[1]) - both, 1e-12) >= least:
                    out.append((r.id, k))
                    break
            else:
                heads.append(b)
                out.append((r.id, len(heads) - 1))
        got = pd.DataFrame(out, columns=["id", "cluster"])
        for k in key:
            got[k] = rows[k].iloc[0]
        return got[[*key, "id", "cluster"]]

    schema = T.StructType([*(boxes.schema[k] for k in key), boxes.schema["id"], T.StructField("cluster", T.LongType())])
    return boxes.groupBy(*key).applyInPandas(run, schema)


def kept_clips(clips: DataFrame, team: str | None = None, warned: bool | None = None, low: float | None = None, edited: bool | None = None) -> DataFrame:
    """Clips by the filters of a review, the least sure first."""
    out = clips
    if team is not None:
        out = out.filter(F.col("team") == team)
    if warned is not None:
        out = out.filter(F.col("warned") == warned)
    if low is not None:
        out = out.filter(F.col("confidence") < low)
    if edited is not None:
        out = out.filter(F.col("edited") == edited)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("game_id").orderBy("confidence", "clip_order")))


def suggested_title(team: Column, opponent: Column, deficit: Column, won: Column) -> Column:
    versus = F.coalesce(F.concat(F.lit(" vs "), F.nullif(opponent, F.lit(""))), F.lit(""))
    d = deficit.cast("string")
    return F.when((deficit >= 10) & won, F.concat(team, F.lit(" "), d, F.lit("-point comeback"), versus)).when(deficit >= 10, F.concat(team, F.lit(" run from "), d, F.lit(" down"), versus)).otherwise(
        F.concat(F.lit("Every "), team, F.lit(" bucket"), versus)
    )


def distinct_tags(tags: Column) -> Column:
    """Tags joined by spaces: empty ones go, and later ones that differ in case only."""
    some = F.filter(tags, lambda t: t != "")
    firsts = F.filter(some, lambda t, i: ~F.exists(F.slice(some, F.lit(1), i), lambda u: F.lower(u) == F.lower(t)))
    return F.array_join(firsts, " ")
