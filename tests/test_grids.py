"""Grids and boxes against plain loops, on odd shapes and nulls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import arrays, grids


def flood(mask, width, corners):
    """Labels by a flood fill from each cell in turn."""
    labels, n = [0] * len(mask), 0
    for s in range(len(mask)):
        if not mask[s] or labels[s]:
            continue
        n, todo = n + 1, [s]
        while todo:
            i = todo.pop()
            if labels[i]:
                continue
            labels[i] = n
            y, x = divmod(i, width)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    j = (y + dy) * width + x + dx
                    if (corners or not (dy and dx)) and 0 <= x + dx < width and 0 <= j < len(mask) and mask[j] and not labels[j]:
                        todo.append(j)
    return labels


@pytest.mark.parametrize("corners", [True, False])
def test_regions_equal_a_flood_fill(spark, corners):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        width, n = rng.randint(1, 9), rng.choice([0, 1, 7, 24, 60])
        share = rng.choice([0.2, 0.5, 0.8, 1.0])
        rows.append((k, [rng.random() < share for _ in range(n)], width))
    rows += [(1000, None, 3), (1001, [True, None, True], 3), (1002, [True] * 5, None), (1003, [True] * 3000, 60)]
    found = grids.regions(spark.createDataFrame(rows, "id int, mask array<boolean>, width int").withColumn("regions", F.lit(1)).repartition(3), "mask", "width", corners).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.mask is None:
            assert r.labels is None and r.regions is None
            continue
        width = r.width or 1
        want = flood(r.mask, width, corners)
        assert r.labels == want, r.id
        boxes = []
        for label in range(1, max(want, default=0) + 1):
            at = [divmod(i, width) for i, x in enumerate(want) if x == label]
            ys, xs = [y for y, _ in at], [x for _, x in at]
            boxes.append((label, min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(at)))
        assert [tuple(x) for x in r.regions] == boxes


def test_a_long_winding_region(spark):
    # a snake: every other row is joined to the next at alternating ends
    width, rows = 41, 81
    mask = [True if y % 2 == 0 else x == (width - 1 if y % 4 == 1 else 0) for y in range(rows) for x in range(width)]
    (r,) = grids.regions(spark.createDataFrame([(mask, width)], "mask array<boolean>, width int"), "mask", "width", False).collect()
    assert len(r.regions) == 1 and r.regions[0].cells == sum(mask)


def test_region_at_a_box(spark):
    mask = [c == "#" for c in "##..." "##..#" "....#" "#...#"]
    found = grids.regions(spark.createDataFrame([(mask, 5)], "mask array<boolean>, width int"), "mask", "width")
    at = lambda *b: grids.region_at(F.col("labels"), F.col("regions"), F.col("width"), F.struct(*(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), b))))["label"]
    got = found.select(at(0, 0, 5, 4).alias("most"), at(1, 1, 5, 2).alias("first_of_equals"), at(2, 0, 4, 1).alias("none")).first()
    assert tuple(got) == (1, 1, None)


def plain_settled(mask, values, width, box, least, smallest, below, most_x, most_y):
    h = -(-len(mask) // width)
    at = lambda a, y, x: float(a[y * width + x] or 0) if y * width + x < len(a) else 0.0
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    x0, y0, x1, y1 = box
    row = lambda a, y: mean([at(a, y, x) for x in range(x0, x1)])
    col = lambda a, x: mean([at(a, y, x) for y in range(y0, y1)])
    while y1 - y0 > smallest and row(mask, y0) < least:
        y0 += 1
    while y1 - y0 > smallest and row(mask, y1 - 1) < least:
        y1 -= 1
    while x1 - x0 > smallest and col(mask, x0) < least:
        x0 += 1
    while x1 - x0 > smallest and col(mask, x1 - 1) < least:
        x1 -= 1
    a, b = x0, x1
    while x0 > 0 and a - x0 < most_x and col(values, x0 - 1) < below:
        x0 -= 1
    while x1 < width and x1 - b < most_x and col(values, x1) < below:
        x1 += 1
    a, b = y0, y1
    while y0 > 0 and a - y0 < most_y and row(values, y0 - 1) < below:
        y0 -= 1
    while y1 < h and y1 - b < most_y and row(values, y1) < below:
        y1 += 1
    return x0, y0, x1, y1


def test_settled_boxes_equal_loops(spark):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        width, h = rng.choice([(8, 6), (5, 9), (12, 12)])
        n = width * h - rng.choice([0, 0, 3])
        box = (rng.randint(0, 2), rng.randint(0, 2), rng.randint(3, width), rng.randint(3, h))
        rows.append((k, [rng.random() < 0.6 for _ in range(n)], [float(rng.randint(0, 9)) if rng.random() < 0.95 else None for _ in range(n)], width, box, float(rng.randint(2, 7))))
    rows += [(900, None, [1.0], 1, (0, 0, 1, 1), 1.0), (901, [True], [1.0], 1, None, 1.0), (902, [], [], 4, (0, 0, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "id int, mask array<boolean>, values array<double>, width int, box struct<x0: int, y0: int, x1: int, y1: int>, below double")
    for r in grids.settled_box(df.repartition(2), "mask", "values", "width", "box", 0.5, 2, "below", 3, 1).collect():
        want = None if r.id >= 900 else plain_settled([float(x) for x in r.mask], r["values"], r.width, r.box, 0.5, 2, r.below, 3, 1)
        assert (r.settled and tuple(r.settled)) == want, r.id


def test_shrunken_boxes_by_summed_areas(spark):
    cells = [float(x) for x in np.random.default_rng(3).integers(-50, 50, 10 * 12)]
    df = spark.createDataFrame([(1, cells, 12, (2, 1, 11, 9)), (2, None, 12, (0, 0, 1, 1)), (3, [5.0], 1, (0, 0, 1, 1))], "id int, cells array<double>, width int, box struct<x0: int, y0: int, x1: int, y1: int>")
    rows = grids.shrunken_sums(df, "cells", "width", "box").collect()
    grid = np.array(cells).reshape(10, 12)
    for r in rows:
        if r.id == 1:
            top, bottom, left, right = grids.SHRINKS[r.candidate]
            part = grid[1 + int(top * 8 + 0.5) : 9 - int(bottom * 8 + 0.5), 2 + int(left * 9 + 0.5) : 11 - int(right * 9 + 0.5)]
            assert (r.total, r.area) == (part.sum(), part.size)
    assert {r.candidate for r in rows if r.id == 1} == set(range(len(grids.SHRINKS))) and {r.id for r in rows} == {1, 3}


def test_best_candidate_is_the_smallest_change_that_reads_best(spark):
    reads = {0: [None, 5.0, None, None], 1: [10.0, 12.0, 2.0, 13.0], 2: [10.0, 12.0, 12.0, 13.0], 3: [10.0, 12.0, 12.0, 13.0]}
    rows = [("a", t, k, v) for k, vs in reads.items() for t, v in enumerate(vs)] + [("b", t, k, v) for k, vs in {0: [1.0, 2.0, None, 3.0, 4.0], 1: [1.0, 2.0, 2.0, 3.0, 4.0]}.items() for t, v in enumerate(vs)]
    got = grids.best_candidates(spark.createDataFrame(rows, "field string, t int, candidate int, value double"), ["field"], ["t"], "value")
    # a: the box itself reads once; 1 reads all with a fall, 2 and 3 without; b: four of five reads are enough
    assert {tuple(r) for r in got.collect()} == {("a", 2, 4, 0), ("b", 0, 4, 0)}


def overlap(a, b):
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def test_padded_boxes_stay_apart(spark):
    rng, rows = random.Random(11), []
    for frame in range(40):
        placed = []
        while len(placed) < 12:
            x, y = rng.randint(5, 90), rng.randint(5, 50)
            b = (x, y, x + rng.randint(1, 14), y + rng.randint(1, 9))
            if not any(overlap(b, o) for o in placed):
                placed.append(b)
        rows += [(frame, k, *b, (0, 0, 105, 60)) for k, b in enumerate(placed)]
    df = spark.createDataFrame(rows, "frame int, name int, x0 int, y0 int, x1 int, y1 int, bug struct<x0: int, y0: int, x1: int, y1: int>")
    pads = {(r.frame, r.name): (r.x0, r.y0, r.x1, r.y1) for r in grids.padded(df, ["frame"], "name", "bug", F.lit(6), F.lit(4)).collect()}
    assert len(pads) == len(rows)
    for frame, name, x0, y0, x1, y1, _ in rows:
        a = pads[frame, name]
        assert 0 <= a[0] <= x0 and 0 <= a[1] <= y0 and x1 <= a[2] <= 105 and y1 <= a[3] <= 60 and x0 - a[0] <= 6 and y0 - a[1] <= 4
        row = [o for f, n, *o, _ in rows if f == frame and n != name and o[3] > y0 and o[1] < y1]
        left = min([6, x0, *((x0 - o[2]) // 2 for o in row if o[2] <= x0)])
        assert a[0] == x0 - left
        assert not any(overlap(a, pads[f, n]) for f, n in pads if f == frame and n != name)


def test_snapped_boxes_keep_out_of_their_neighbours_text(spark):
    schema = "frame int, name string, x0 int, y0 int, x1 int, y1 int"
    texts = spark.createDataFrame([(1, "clock", 10, 0, 30, 10), (1, "shot", 40, 2, 50, 12), (1, "below", 10, 20, 50, 30)], schema)
    snapped = spark.createDataFrame([(1, "clock", 5, 0, 52, 10), (1, "shot", 28, 2, 55, 12), (1, "below", 5, 18, 60, 30), (1, "new", 0, 0, 99, 9)], schema)
    got = {r.name: (r.x0, r.x1) for r in grids.separated(snapped, texts, ["frame"], "name").collect()}
    assert got == {"clock": (5, 40), "shot": (30, 55), "below": (5, 60), "new": (0, 99)}


def test_free_run_stops_at_the_first_large_step(spark):
    steps = [1.0, 2.0, 30.0, 1.0, 1.0, 50.0, 1.0]

    def walk(at, way, limit):
        n = 0
        while n < limit and 0 <= at + way <= len(steps) and steps[min(at, at + way)] <= 10:
            at, n = at + way, n + 1
        return n

    df = spark.createDataFrame([(steps, a, n) for a in range(8) for n in (0, 1, 3, 20)], "steps array<double>, at int, n int")
    for r in df.select("at", "n", grids.free_run(F.col("steps"), F.col("at"), F.col("n"), 10.0).alias("ahead"), grids.free_run(F.col("steps"), F.col("at"), F.col("n"), 10.0, True).alias("behind")).collect():
        assert (r.ahead, r.behind) == (walk(r.at, 1, r.n), walk(r.at, -1, r.n)), r


def test_masked_decoding(spark):
    probs = [[0.1, 0.2, 0.6, 0.1], [0.1, 0.5, 0.3, 0.1], [0.9, 0.05, 0.05, 0.0], [0.1, 0.4, 0.4, 0.1], [0.2, 0.1, 0.1, 0.6]]
    df = spark.createDataFrame([(probs, [0, 1, 2, 3]), (probs, [0, 1]), (probs, [0]), ([], [0, 1]), (None, [0])], "steps array<array<double>>, allowed array<int>")
    got = df.select(arrays.masked_decode(F.col("steps"), F.array(*map(F.lit, ["", "1", "2", ":"])), F.col("allowed")).alias("d")).select("d.*").collect()
    # all: 2, 1, blank, 1 (the first of equals), colon; only 1: 1 1 blank 1 blank
    assert [tuple(r) for r in got] == [("211:", 0.4), ("11", 0.2), ("", 0.0), ("", 0.0), (None, 0.0)]
