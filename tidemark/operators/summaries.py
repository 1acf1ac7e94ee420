"""Aggregates and rankings over entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import lately


def largest_deficit(rows: DataFrame, key: list[str], own: str, other: str, order: list[str], take: list[str]) -> DataFrame:
    """The row at which the entity trails most; the latest of equals. Entities that never trail are left out."""
    d = F.col(other) - F.col(own)
    best = F.max_by(F.struct(*take, d.alias("deficit")), F.struct(d, *order))
    return rows.filter(d > 0).groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def first_seen(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The first value by order; ties by value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.min_by(value, F.struct(order, value)).alias(value))


def top_by_sum(rows: DataFrame, key: list[str], name: str, amount: str, order: str, k: int) -> DataFrame:
    """The k names with the largest sums; equals in order of first appearance."""
    sums = rows.groupBy(*key, name).agg(F.sum(amount).alias("total"), F.min(order).alias("_first"))
    w = Window.partitionBy(*key).orderBy(F.desc("total"), "_first", name)
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_first")


def median_if_enough(rows: DataFrame, key: list[str], value: str, least: int) -> DataFrame:
    """Exact median; NULL for fewer than ``least`` values."""
    return rows.groupBy(*key).agg(F.when(F.count(value) >= least, F.median(value)).alias("median"), F.count(value).alias("n"))


def commonest(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value; the smallest of equals."""
    counts = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def ordered_distinct(rows: DataFrame, key: list[str], value: str, order: str, out: str, sep: str = " / ") -> DataFrame:
    """Distinct values of an entity joined in the order of their first appearance."""
    firsts = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(order).alias("_at"))
    return firsts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]), sep).alias(out))


def clip_confidence(least: Column, trimmed: Column, warned: Column) -> Column:
    """Half plus half of the weakest reading, less a fifth for a trim and for a warning."""
    c = 0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), least))
    return F.round(c * F.when(trimmed, 0.8).otherwise(1.0) * F.when(warned, 0.8).otherwise(1.0), 3)


def one_sided(miss_a: Column, miss_b: Column) -> Column:
    """Which of two readings fails far more often than the other."""
    return F.when((miss_a > 0.3) & (miss_a > 2 * miss_b), "a").when((miss_b > 0.3) & (miss_b > 2 * miss_a), "b")


def oldest_until_room(files: DataFrame, key: list[str], order: list[str], size: str, need: Column) -> DataFrame:
    """The oldest files that must go to free ``need``: the one that reaches it is the last."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("freed_before", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("freed_before") < need)


def eta(elapsed: Column, fraction: Column, least_fraction: float = 0.03, least_elapsed: float = 4.0) -> Column:
    """Seconds left by the share done, in steps of five, at least five; NULL while there is too little to go on."""
    left = F.greatest(F.lit(5.0), F.bround(elapsed * (1.0 - fraction) / fraction / 5) * 5)
    return F.when((fraction >= least_fraction) & (elapsed >= least_elapsed), left)


def latest_with_count(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key)
    return rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order))).filter("_r = 1").drop("_r")


def changed_rows(rows: DataFrame, key: list[str], order: list[str], watched: list[str]) -> DataFrame:
    """Rows that differ from the one before in a watched column."""
    now, before = F.struct(*watched), F.lag(F.struct(*watched)).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_same", now.eqNullSafe(before)).filter("NOT _same").drop("_same")


def recent_count(rows: DataFrame, key: list[str], at: str, seconds: float, on: Column, out: str = "recent") -> DataFrame:
    """How many ``on`` rows an entity had in the last ``seconds``, the row itself included."""
    return rows.withColumn("_on", on.cast("long")).withColumn(out, lately("sum(_on)", key, at, seconds)).drop("_on")


def spent(usage: DataFrame, prices: DataFrame, key: list[str], on: str, budget: float) -> DataFrame:
    """Cost of usage at the price of its kind, and whether the budget is used up."""
    cost = usage.join(prices, on).groupBy(*key).agg(F.sum(F.col("units") * F.col("price")).alias("cost"))
    return cost.withColumn("over", F.col("cost") > budget)


def stale_files(files: DataFrame, uses: DataFrame, path: str, used_at: str, busy: str, before: Column) -> DataFrame:
    """Files not used since ``before`` and not in use; files without any use are stale."""
    per = uses.groupBy(path).agg(F.max(used_at).alias("_last"), F.bool_or(busy).alias("_busy"))
    kept = per.filter(F.col("_busy") | (F.col("_last") >= before))
    return files.join(kept, path, "left_anti")
