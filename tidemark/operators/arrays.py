"""Numbers in arrays: similarities, per-position statistics, histograms, decoding, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return total(xs) / F.size(xs)


def correlation(a: Column, b: Column) -> Column:
    """Normalised cross-correlation of two arrays of numbers; NULL if one is flat."""

    def of(ma: Column, mb: Column) -> Column:
        dot = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
        na = total(F.transform(a, lambda x: (x - ma) * (x - ma)))
        nb = total(F.transform(b, lambda y: (y - mb) * (y - mb)))
        return F.when((na > 0) & (nb > 0), dot / F.sqrt(na * nb))

    return of(mean(a), mean(b))


def mean_difference(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def better_half(xs: Column) -> Column:
    """Mean of the larger half."""
    top = F.slice(F.sort_array(xs, asc=False), F.lit(1), F.greatest(F.lit(1), F.floor(F.size(xs) / 2).cast("int")))
    return mean(top)


def position_medians(rows: DataFrame, key: list[str], array: str) -> DataFrame:
    """The median and population deviation at each array position over an entity's rows."""
    cells = rows.select(*key, F.posexplode(array).alias("at", "x"))
    return cells.groupBy(*key, "at").agg(F.median("x").alias("median"), F.stddev_pop("x").alias("std"))


def steady_share(rows: DataFrame, key: list[str], array: str, most: float) -> DataFrame:
    """Share of positions whose second largest deviation from the median is below ``most``."""
    cells = rows.select(*key, F.posexplode(array).alias("at", "x"))
    mid = F.median("x").over(Window.partitionBy(*key, "at"))
    off = cells.withColumn("off", F.abs(F.col("x") - mid))
    # a window, not a collected list: a position may have as many rows as the entity
    ranked = off.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "at").orderBy(F.desc("off"))))
    second = ranked.groupBy(*key, "at").agg(F.max(F.when(F.col("_r") == 2, F.col("off"))).alias("second"))
    return second.groupBy(*key).agg((F.count_if(F.col("second") < most) / F.count(F.lit(1))).alias("steady"))


def common_bins(rows: DataFrame, key: list[str], array: str, width: float, share: float) -> DataFrame:
    """Histogram bins that are at least ``share`` as frequent as the most frequent one."""
    bins = rows.select(*key, F.explode(array).alias("x")).select(*key, F.floor(F.col("x") / width).cast("long").alias("bin"))
    counts = bins.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_top", F.max("n").over(Window.partitionBy(*key))).filter(F.col("n") >= F.col("_top") * share).drop("_top")


def collapsed(best: Column, blank: int = 0) -> Column:
    """Class numbers without repeats and blanks (CTC)."""
    pairs = F.zip_with(best, F.concat(F.array(F.lit(-1)), F.slice(best, F.lit(1), F.greatest(F.size(best) - 1, F.lit(0)))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(F.filter(pairs, lambda p: (p["x"] != p["y"]) & (p["x"] != blank)), lambda p: p["x"])


def ink_runs(xs: Column, least: float) -> Column:
    """Runs of values of at least ``least``: an array of structs (first, last)."""
    at = F.filter(F.transform(xs, lambda x, i: F.when(x >= least, i)), lambda i: i.isNotNull())
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, i: Column) -> Column:
        n = F.size(acc)
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), i.alias("last"))))
        fresh = F.concat(acc, F.array(F.struct(i.alias("first"), i.alias("last"))))
        return F.when((n > 0) & (F.try_element_at(acc, F.lit(-1))["last"] == i - 1), grown).otherwise(fresh)

    return F.aggregate(at, empty, step)


def masked_decode(steps: Column, symbols: Column, allowed: Column, blank: int = 0) -> Column:
    """struct(text, confidence): the likeliest allowed class at each step, without repeats and blanks, and the least probability kept.

    ``steps`` is an array of arrays of class probabilities, ``allowed`` an array of class numbers. The
    confidence is the plain probability, so a step that would rather have been another class is
    weak. The first of equally likely classes counts. Nothing kept: empty text, confidence 0.
    """
    best = F.transform(steps, lambda p: F.array_max(F.transform(allowed, lambda k: F.struct(F.get(p, k).alias("p"), (-k).alias("k")))))
    before = F.concat(F.array(F.lit(-1)), F.transform(F.slice(best, F.lit(1), F.greatest(F.size(best) - 1, F.lit(0))), lambda s: -s["k"]))
    moved = F.zip_with(best, before, lambda s, k: F.struct(s["p"].alias("p"), (-s["k"]).alias("k"), (-s["k"] != k).alias("moved")))
    kept = F.filter(moved, lambda s: s["moved"] & (s["k"] != blank))
    text = F.array_join(F.transform(kept, lambda s: F.get(symbols, s["k"])), "")
    return F.struct(text.alias("text"), F.coalesce(F.array_min(F.transform(kept, lambda s: s["p"])), F.lit(0.0)).alias("confidence"))
