"""Two-dimensional arrays stored row by row: connected regions, boxes that move to their edges, search over shrunken boxes.

A grid is an array column and its width; rows of a table are independent grids, of any and of
different sizes. The work is numpy over whole Arrow batches inside tasks: no row leaves its
partition, nothing is grouped.

Null entries are not set (in masks) or zero (in values); a null grid gives null results, an empty
one no regions. A last row that is cut short counts as filled up with entries that are not set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Box = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected to by the links a-b, all links at a time."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def label_runs(mask: np.ndarray, width: np.ndarray, size: np.ndarray, corners: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set cells in each row of all grids (flat, one after the other), and the region of each run.

    grid, y, x of the first and of the last cell, and region, numbered from 1 within a grid by its first cell.
    """
    grid = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(mask)) - np.repeat(np.cumsum(size) - size, size)
    y, x = inside // width[grid], inside % width[grid]
    opens = mask & ((x == 0) | ~np.concatenate([[False], mask[:-1]]))
    new_grid_next = np.concatenate([grid[1:] != grid[:-1], [True]]) if len(mask) else np.zeros(0, bool)
    closes = mask & ((x == width[grid] - 1) | new_grid_next | ~np.concatenate([mask[1:], [False]]))
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    # every row of every grid has its own stretch of keys, with an empty one between two grids
    rows = -(-size // np.maximum(width, 1)) + 1
    row = (np.cumsum(rows) - rows)[grid[first]] + y[first]
    span = int(width.max(initial=0)) + 3
    start_key, end_key = row * span + x[first] + 1, row * span + x[last] + 1
    reach = 1 if corners else 0
    low = np.searchsorted(end_key, start_key + span - reach)
    high = np.searchsorted(start_key, end_key + span + reach, side="right")
    n = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(first)), n)
    below = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = roots(above, below, len(first))
    found, region = np.unique(root, return_inverse=True)
    before = np.searchsorted(grid[first][found], np.arange(len(size)))  # regions of earlier grids
    return grid[first], y[first], x[first], x[last], region - before[grid[first]] + 1, first


def regions(df: DataFrame, mask: str, width: str, corners: bool = True) -> DataFrame:
    """``df`` with ``labels`` (0 where not set) and ``regions`` (label, x0, y0, x1, y1, cells; ends exclusive) of each grid.

    Two passes: runs of cells of neighbouring rows are linked, then each run takes the least run it
    is connected to. ``corners``: cells that meet at a corner are connected, too.
    """
    parts = ("label", "x0", "y0", "x1", "y1", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, widths = batch.column(mask), batch.column(width).fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            size = np.where(known, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            flat = lists.flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            grid, y, x0, x1, region, first = label_runs(flat, np.maximum(widths, 1), size, corners)
            labels, length = np.zeros(len(flat), np.int32), x1 - x0 + 1
            at = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            labels[at] = np.repeat(region, length)
            order = np.lexsort((region, grid))
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(grid[order]) != 0) | (np.diff(region[order]) != 0)])) if len(order) else order
            cut = lambda f, v: f.reduceat(v[order], edge) if len(order) else v
            values = [region[order][edge], cut(np.minimum, x0), cut(np.minimum, y), cut(np.maximum, x1) + 1, cut(np.maximum, y) + 1, cut(np.add, length)]
            structs = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in values], names=parts)
            per = np.bincount(grid[order][edge], minlength=len(batch)) if len(order) else np.zeros(len(batch), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(pa.array(labels), size, known), _lists(structs, per, known)], names=[*batch.schema.names, "labels", "regions"])

    kept = df.drop("labels", "regions")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, labels array<int>, regions array<struct<{', '.join(f'{p}: int' for p in parts)}>>")


def _lists(values: pa.Array, size: np.ndarray, known: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(~known))


def region_at(labels: Column, found: Column, width: Column, box: Column) -> Column:
    """Of ``regions`` the one with the most cells in a box (struct x0, y0, x1, y1), the first of equals; NULL if none has any."""
    inside = lambda i: ((i % width) >= box["x0"]) & ((i % width) < box["x1"]) & (i >= box["y0"] * width) & (i < box["y1"] * width)
    near = F.filter(F.transform(labels, lambda x, i: F.when(inside(i), x)), lambda x: x > 0)
    scored = F.transform(found, lambda r: F.struct(F.size(F.filter(near, lambda x: x == r["label"])).alias("n"), (-r["label"]).alias("k"), r.alias("r")))
    best = F.array_max(F.filter(scored, lambda s: s["n"] > 0))
    return best["r"]


def summed(cells: np.ndarray) -> np.ndarray:
    """Summed-area tables of grids (n, h, w): entry (y, x) is the sum of the cells above and left of it."""
    out = np.zeros((cells.shape[0], cells.shape[1] + 1, cells.shape[2] + 1))
    np.cumsum(np.cumsum(cells, 1), 2, out=out[:, 1:, 1:])
    return out


def box_sums(table: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Sums of one box of each grid: four lookups."""
    g = np.arange(len(table))
    return table[g, y1, x1] - table[g, y0, x1] - table[g, y1, x0] + table[g, y0, x0]


def run_length(good: np.ndarray, at: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """How many entries of each row from ``at`` on (or before it, going back) are good in a row, at most ``limit``."""
    place = np.arange(good.shape[1])
    if back:
        stop = np.where((place < at[:, None]) & ~good, place + 1, 0).max(1, initial=0)
        return np.minimum(at - stop, limit)
    stop = np.where((place >= at[:, None]) & ~good, place, good.shape[1]).min(1, initial=good.shape[1])
    return np.minimum(stop - at, limit)


def line_means(table: np.ndarray, low: np.ndarray, high: np.ndarray, columns: bool) -> np.ndarray:
    """Means of every column over rows low..high-1 of each grid, or of every row over columns low..high-1."""
    g = np.arange(len(table))
    edge = (table[g, high] - table[g, low]) if columns else (table[g, :, high] - table[g, :, low])
    return np.diff(edge, axis=1) / np.maximum(high - low, 1)[:, None]


def trimmed(table: np.ndarray, box: Box, least: float, smallest: np.ndarray) -> Box:
    """Boxes without outer rows, then columns, of which less than ``least`` is set, down to ``smallest`` in each direction."""
    x0, y0, x1, y1 = box
    row = line_means(table, x0, x1, False) < least
    y0 = y0 + run_length(row, y0, np.maximum(y1 - y0 - smallest, 0), False)
    y1 = y1 - run_length(row, y1, np.maximum(y1 - y0 - smallest, 0), True)
    column = line_means(table, y0, y1, True) < least
    x0 = x0 + run_length(column, x0, np.maximum(x1 - x0 - smallest, 0), False)
    x1 = x1 - run_length(column, x1, np.maximum(x1 - x0 - smallest, 0), True)
    return x0, y0, x1, y1


def grown(table: np.ndarray, box: Box, below: np.ndarray, most_x: np.ndarray, most_y: np.ndarray) -> Box:
    """Boxes with the columns, then rows, next to them as long as their mean stays ``below``."""
    x0, y0, x1, y1 = box
    column = line_means(table, y0, y1, True) < below[:, None]
    x0, x1 = x0 - run_length(column, x0, most_x, True), x1 + run_length(column, x1, most_x, False)
    row = line_means(table, x0, x1, False) < below[:, None]
    y0, y1 = y0 - run_length(row, y0, most_y, True), y1 + run_length(row, y1, most_y, False)
    return x0, y0, x1, y1


def _by_shape(batch: pa.RecordBatch, arrays: list[str], width: str, box: str) -> Iterator[tuple[np.ndarray, list[np.ndarray], Box]]:
    """Row numbers, grids (n, h, w) and boxes, clipped to their grid, of the rows of each shape; rows of nulls are in none."""
    size = batch.column(arrays[0]).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    widths = batch.column(width).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ok = (size > 0) & (widths > 0) & batch.column(box).is_valid().to_numpy(zero_copy_only=False)
    for a in arrays:
        ok &= batch.column(a).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == size
    for n, w in sorted(set(zip(size[ok].tolist(), widths[ok].tolist()))):
        rows = np.flatnonzero(ok & (size == n) & (widths == w))
        part, h = batch.take(pa.array(rows)), -(-n // w)
        grids = []
        for a in arrays:
            flat = part.column(a).flatten().cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False).reshape(len(rows), n)
            grids.append(np.pad(flat, ((0, 0), (0, h * w - n))).reshape(len(rows), h, w))
        ends = part.column(box)
        x0, y0, x1, y1 = (np.clip(ends.field(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0, m) for c, m in (("x0", w), ("y0", h), ("x1", w), ("y1", h)))
        yield rows, grids, (x0, y0, np.maximum(x0, x1), np.maximum(y0, y1))


def settled_box(df: DataFrame, mask: str, values: str, width: str, box: str, least: float, smallest: int, below: str, most_x: int, most_y: int) -> DataFrame:
    """``df`` with ``settled``: ``box`` without edges of ``mask`` that are mostly unset, grown where ``values`` beside it stay below a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, known = np.zeros((4, len(batch)), np.int32), np.zeros(len(batch), bool)
            # a boolean mask counts as 0 and 1
            counted = batch.set_column(batch.schema.get_field_index(mask), mask, _ones(batch.column(mask)))
            limit = batch.column(below).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            for rows, (set_, level), found in _by_shape(counted, [mask, values], width, box):
                n = np.full(len(rows), smallest)
                found = trimmed(summed(set_), found, least, n)
                out[:, rows] = grown(summed(level), found, limit[rows], np.full(len(rows), most_x), np.full(len(rows), most_y))
                known[rows] = True
            boxes = pa.StructArray.from_arrays([pa.array(v) for v in out], names=["x0", "y0", "x1", "y1"], mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*batch.columns, boxes], names=[*batch.schema.names, "settled"])

    kept = df.drop("settled")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, settled struct<x0: int, y0: int, x1: int, y1: int>")


def _ones(column: pa.ListArray) -> pa.ListArray:
    values = column.flatten().fill_null(False).cast(pa.int8())
    sizes, known = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
    return _lists(values, sizes, known)


#: Parts of a box's height and width that are cut off its top, bottom, left and right, from none on: what is tried, in this order (fixed values).
SHRINKS = (
    (0.0, 0.0, 0.0, 0.0),
    (0.08, 0.08, 0.0, 0.0), (0.16, 0.16, 0.0, 0.0), (0.25, 0.25, 0.0, 0.0), (0.0, 0.0, 0.08, 0.08), (0.0, 0.0, 0.16, 0.16), (0.0, 0.0, 0.0, 0.16),
    (0.0, 0.0, 0.0, 0.3), (0.0, 0.0, 0.16, 0.0), (0.0, 0.0, 0.3, 0.0), (0.08, 0.08, 0.08, 0.08), (0.16, 0.16, 0.16, 0.16),
)


def shrunken_sums(df: DataFrame, values: str, width: str, box: str, shrinks: tuple = SHRINKS) -> DataFrame:
    """``df`` with a row for each shrunken box that holds a cell: ``candidate`` (its place in ``shrinks``), ``total`` and ``area``.

    Edges go to the nearest cell border, inwards from halfway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, (grid,), (x0, y0, x1, y1) in _by_shape(batch, [values], width, box):
                table, part = summed(grid), batch.take(pa.array(rows))
                for k, (top, bottom, left, right) in enumerate(shrinks):
                    h, w = y1 - y0, x1 - x0
                    a, b = x0 + np.floor(left * w + 0.5).astype(int), x1 - np.floor(right * w + 0.5).astype(int)
                    c, d = y0 + np.floor(top * h + 0.5).astype(int), y1 - np.floor(bottom * h + 0.5).astype(int)
                    some = (b > a) & (d > c)
                    sums = box_sums(table, a, c, np.maximum(a, b), np.maximum(c, d))
                    columns = [*part.columns, pa.array(np.full(len(rows), k, np.int32)), pa.array(sums), pa.array(((b - a) * (d - c)).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "candidate", "total", "area"]).filter(pa.array(some))

    kept = df.drop("candidate", "total", "area")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, candidate int, total double, area int")


def best_candidates(reads: DataFrame, key: list[str], order: list[str], value: str, enough: float = 0.8) -> DataFrame:
    """Each entity's ``candidate`` with the most reads, then the fewest falls between neighbouring reads, then the first; ``n_read``, ``n_falls``.

    ``reads`` has a row for each frame and candidate, ``value`` NULL where nothing was read. The first
    candidate (0) stays where it reads ``enough`` of its frames without a fall.
    """
    w = Window.partitionBy(*key, "candidate").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = reads.withColumn("_fall", F.col(value) < F.last(value, ignorenulls=True).over(w))
    per = marked.groupBy(*key, "candidate").agg(F.count(value).alias("n_read"), F.count_if("_fall").alias("n_falls"), F.count(F.lit(1)).alias("n"))
    fine = (F.col("candidate") == 0) & (F.col("n_read") >= enough * F.col("n")) & (F.col("n_falls") == 0)
    score = F.struct(fine, F.col("n_read"), -F.col("n_falls"), -F.col("candidate"))
    best = per.groupBy(*key).agg(F.max_by(F.struct("candidate", "n_read", "n_falls"), score).alias("_b"))
    return best.select(*key, "_b.*")


def row_neighbours(boxes: DataFrame, key: list[str], name: str, across: str = "x", along: str = "y") -> DataFrame:
    """key, name, ``before`` and ``after``: where on each side the nearest other box begins that shares a row with this one; NULL if none.

    A sweep over the boxes' edges in each row of cells: going forth, the last end seen where a box
    starts; going back, the last start seen where it ends. ``across`` 'y' and ``along`` 'x' look up
    and down. Boxes are whole numbers (x0, y0, x1, y1), ends exclusive, and have a row for each cell
    of their height, so coarse grids are cheaper. Boxes that overlap are not each other's neighbours.
    """
    low, high = f"{across}0", f"{across}1"
    rows = boxes.filter((F.col(f"{along}1") > F.col(f"{along}0")) & (F.col(high) > F.col(low)))
    cells = rows.select(*key, name, F.explode(F.sequence(F.col(f"{along}0"), F.col(f"{along}1") - 1)).alias("_row"), F.array(F.struct(F.col(low).alias("at"), F.lit(1).alias("start")), F.struct(F.col(high).alias("at"), F.lit(0).alias("start"))).alias("_edges"))
    edges = cells.select(*key, name, "_row", F.explode("_edges").alias("_e")).select(*key, name, "_row", "_e.*")
    w = Window.partitionBy(*key, "_row")
    run = lambda o: w.orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    forth = F.max(F.when(F.col("start") == 0, F.col("at"))).over(run([F.asc("at"), F.asc("start")]))
    back = F.min(F.when(F.col("start") == 1, F.col("at"))).over(run([F.desc("at"), F.desc("start")]))
    seen = edges.withColumn("_before", forth).withColumn("_after", back)
    return seen.groupBy(*key, name).agg(F.max(F.when(F.col("start") == 1, F.col("_before"))).alias("before"), F.min(F.when(F.col("start") == 0, F.col("_after"))).alias("after"))


def free_run(steps: Column, at: Column, limit: Column, most: float, back: bool = False) -> Column:
    """How many cells lie between ``at`` and the first step over ``most``: ``steps[i]`` is the step from cell i to i + 1."""
    if back:
        ahead = F.reverse(F.slice(steps, F.greatest(at - limit, F.lit(0)) + 1, F.least(limit, at)))
    else:
        ahead = F.slice(steps, at + 1, F.greatest(F.least(limit, F.size(steps) - at), F.lit(0)))
    stops = F.filter(F.transform(ahead, lambda s, i: F.when(s > most, i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(stops, F.lit(1)), F.size(ahead))


def padded(boxes: DataFrame, key: list[str], name: str, outer: str, pad_x: Column, pad_y: Column) -> DataFrame:
    """``boxes`` with each side moved out by a pad, but not out of ``outer`` nor over half of the way to the next box on that side.

    First to the sides, against boxes that share a row; then up and down, against boxes that now
    share a column. Boxes that were apart stay apart.
    """
    half = lambda gap, pad: F.least(pad, F.coalesce(F.floor(gap / 2), pad))
    side = row_neighbours(boxes, key, name)
    wide = boxes.join(side, [*key, name], "left")
    left = F.least(half(F.col("x0") - F.col("before"), pad_x), F.col("x0") - F.col(outer)["x0"])
    right = F.least(half(F.col("after") - F.col("x1"), pad_x), F.col(outer)["x1"] - F.col("x1"))
    wide = wide.withColumns({"_l": F.greatest(left, F.lit(0)), "_r": F.greatest(right, F.lit(0))})
    wide = wide.withColumns({"x0": (F.col("x0") - F.col("_l")).cast("int"), "x1": (F.col("x1") + F.col("_r")).cast("int")}).drop("before", "after", "_l", "_r")
    tall = wide.join(row_neighbours(wide, key, name, "y", "x"), [*key, name], "left")
    top = F.least(half(F.col("y0") - F.col("before"), pad_y), F.col("y0") - F.col(outer)["y0"])
    bottom = F.least(half(F.col("after") - F.col("y1"), pad_y), F.col(outer)["y1"] - F.col("y1"))
    tall = tall.withColumns({"_t": F.greatest(top, F.lit(0)), "_b": F.greatest(bottom, F.lit(0))})
    return tall.withColumns({"y0": (F.col("y0") - F.col("_t")).cast("int"), "y1": (F.col("y1") + F.col("_b")).cast("int")}).select(*boxes.columns)


def separated(snapped: DataFrame, texts: DataFrame, key: list[str], name: str) -> DataFrame:
    """Snapped boxes cut where, in the row of their own text, the text of another field begins; those without text stay."""
    limits = row_neighbours(texts, key, name)
    cut = snapped.join(limits, [*key, name], "left")
    return cut.withColumns({"x0": F.greatest("x0", "before"), "x1": F.least("x1", "after")}).drop("before", "after")
