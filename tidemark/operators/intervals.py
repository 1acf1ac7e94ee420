"""Interval algebra on rows (entity, a, b); half-open, all expressed as windows and range joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge(spans: DataFrame, key: list[str], gap: float = 0.0) -> DataFrame:
    """Union of spans; spans at most ``gap`` apart (touching ones too) join."""
    w = Window.partitionBy(*key).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("a") > reach + gap).cast("int"), F.lit(1))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return spans.select(*key, "a", "b").withColumn("_new", new).withColumn("_island", island).groupBy(*key, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def subtract(spans: DataFrame, holes: DataFrame, key: list[str]) -> DataFrame:
    """Spans without what holes cover. Holes are merged first, so their order doesn't matter.

    Each span meets the holes that cut it by a range condition within its entity; the pieces are
    the stretches between the span's start, the holes in order, and its end. Equal spans of an
    entity are cut once and given as often as they are there.
    """
    h = merge(holes, key).select(*(F.col(k).alias(f"_{k}") for k in key), F.col("a").alias("_h0"), F.col("b").alias("_h1"))
    own = spans.groupBy(*key, "a", "b").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    on = [own[k].eqNullSafe(h[f"_{k}"]) for k in key] + [h["_h1"] > own["a"], h["_h0"] < own["b"]]
    cut = own.join(h, on, "left").drop(*(f"_{k}" for k in key))
    per = cut.groupBy(*key, "a", "b", "_copies").agg(F.sort_array(F.collect_list(F.when(F.col("_h0").isNotNull(), F.struct("_h0", "_h1")))).alias("_holes"))
    starts = F.concat(F.array("a"), F.transform("_holes", lambda x: x["_h1"]))
    ends = F.concat(F.transform("_holes", lambda x: x["_h0"]), F.array("b"))
    pieces = F.filter(F.zip_with(starts, ends, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda p: p["b"] > p["a"])
    all_ = F.flatten(F.array_repeat(pieces, F.col("_copies")))
    return per.withColumn("_p", F.explode(all_)).select(*key, F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))


def clamp(spans: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Spans cut to [lo, hi]; empty ones go."""
    return spans.withColumn("a", F.greatest("a", lo)).withColumn("b", F.least("b", hi)).filter("b > a")


def long_enough(spans: DataFrame, least: float, digits: int = 3) -> DataFrame:
    return spans.filter(F.col("b") - F.col("a") >= least).withColumn("a", F.round("a", digits)).withColumn("b", F.round("b", digits))


def total(spans: DataFrame, key: list[str]) -> DataFrame:
    return spans.groupBy(*key).agg(F.sum(F.col("b") - F.col("a")).alias("total"))


def containing(points: DataFrame, spans: DataFrame, key: list[str], at: str) -> DataFrame:
    """Points in some span [a, b): a semi-join on the entity and the range."""
    s = spans.select(*(F.col(k).alias(f"_{k}") for k in key), "a", "b")
    return points.join(s, [points[k] == s[f"_{k}"] for k in key] + [points[at] >= s["a"], points[at] < s["b"]], "left_semi")


def overlaps(left: DataFrame, right: DataFrame, key: list[str], least: float = 1e-3) -> DataFrame:
    """Pairs of spans of an entity that share more than ``least``, with the shared part."""
    r = right.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("a").alias("_a"), F.col("b").alias("_b"))
    found = left.join(r, [left[k] == r[f"_{k}"] for k in key] + [left["a"] < r["_b"], r["_a"] < left["b"]])
    shared = F.least("b", "_b") - F.greatest("a", "_a")
    return found.withColumn("shared", shared).filter(F.col("shared") > least).drop(*(f"_{k}" for k in key))


def snapped(spans: DataFrame, key: list[str], num: int, den: int, gap_halves: int = 3, least: int = 2) -> DataFrame:
    """Spans in whole frames of num/den a second: start and count; gaps of up to 1.5 frames close, short ones go."""
    frame = lambda c: F.floor(F.col(c) * num / den + F.lit(0.5)).cast("long")
    # frame numbers are whole, so 1.5 frames are one
    joined = merge(spans.select(*key, frame("a").alias("a"), frame("b").alias("b")), key, gap_halves // 2)
    return joined.filter(F.col("b") - F.col("a") >= least).select(*key, F.col("a").alias("first_frame"), (F.col("b") - F.col("a")).alias("frames"))


def place_in_cut(spans: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Spans with their start and end in the concatenation of all."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("b") - F.col("a")).over(w)
    return spans.withColumn("out_end", end).withColumn("out_start", F.col("out_end") - (F.col("b") - F.col("a")))


def moved_edges(segments: Column, d_in: Column, d_out: Column, least: float, duration: Column) -> Column:
    """An array of segments with the first start and last end moved, ``least`` seconds kept in both, within [0, duration]."""
    n = F.size(segments)
    edit = lambda s, i: F.struct(
        F.when(i == 0, F.greatest(F.lit(0.0), F.least(s["a"] + d_in, s["b"] - least))).otherwise(s["a"]).alias("a"),
        F.when(i == n - 1, F.least(duration, F.greatest(s["b"] + d_out, s["a"] + least))).otherwise(s["b"]).alias("b"),
    )
    return F.transform(segments, edit)


def edge_trims(flags: Column, rate: float, duration: Column, keep: Column, margin: float = 0.1, tail: float = 2.0, head_within: float = 2.5, head_rows: int = 2, head: float = 12.0) -> tuple[Column, Column]:
    """Seconds to cut at the front and the end of a clip from flags of cutaway rows.

    A trailing run that takes at most ``tail`` seconds (up to ``margin`` after the last good row)
    goes; a leading run that starts within ``head_within`` seconds, has ``head_rows`` rows and
    ends within ``head`` seconds goes with all before its end. If less than ``keep`` would stay,
    the front stays whole, then the end.
    """
    n = F.size(flags)
    text = F.array_join(F.transform(flags, lambda x: F.when(x, "x").otherwise(".")), "")
    good = n - F.length(F.regexp_extract(text, "(x*)$", 1))
    cut = duration - ((good - 1) / rate + margin)
    back = F.when((good > 0) & (good < n) & (cut > 0) & (cut <= tail), cut).otherwise(0.0)
    first = F.length(F.regexp_extract(text, r"^(\.*)x", 1))
    rows = F.length(F.regexp_extract(text, r"^\.*(x+)", 1))
    end = first + rows
    front = F.when((rows >= head_rows) & (first / rate <= head_within) & (end < n) & (end / rate <= head), end / rate).otherwise(0.0)
    front = F.when(duration - front - back < keep, 0.0).otherwise(front)
    back = F.when((duration - front - back < keep) & (duration - back < keep), 0.0).otherwise(back)
    return F.round(front, 3), F.round(back, 3)


def fold_clips(clips: DataFrame, key: list[str], least: float = 0.4) -> DataFrame:
    """Clips (a, b, team, order by a) folded in order: the same team's overlap joins, another team's is cut at the previous end.

    Each step depends on the end that the step before left, so an entity is one grouped map.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in rows.sort_values(["a", "b", "team"], kind="stable").to_dict("records"):
            last = out[-1] if out else None
            if last and r["a"] <= last["b"] and r["team"] == last["team"]:
                # a clip that was cut may be reached back over by one that joins it
                last["a"], last["b"], last["n"] = min(last["a"], r["a"]), max(last["b"], r["b"]), last["n"] + 1
            elif last and r["a"] <= last["b"]:
                r["a"] = last["b"]
                if r["b"] - r["a"] >= least:
                    out.append({**r, "n": 1})
            else:
                out.append({**r, "n": 1})
        return pd.DataFrame(out, columns=[*key, "a", "b", "team", "n"])

    own = clips.select(*key, "a", "b", "team")
    return own.groupBy(*key).applyInPandas(run, T.StructType([*own.schema.fields, T.StructField("n", T.LongType())]))
