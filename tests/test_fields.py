"""Fields of text boxes against one pass over all boxes of a source."""

import random

from tidemark.operators import fields

SCHEMA = "source string, id int, split boolean, x0 double, y0 double, x1 double, y1 double"


def test_clusters_equal_a_pass_over_all_boxes(spark):
    rng, rows = random.Random(9), []
    for source, n, spots in (("a", 150, 12), ("b", 60, 3), (None, 40, 40), ("one", 1, 1)):
        places = [(rng.uniform(0, 0.9), rng.uniform(0, 0.9), rng.uniform(0.005, 0.2), rng.uniform(0.005, 0.05)) for _ in range(spots)]
        for k in range(n):
            x, y, w, h = rng.choice(places)
            x, y, w, h = x + rng.gauss(0, 0.004), y + rng.gauss(0, 0.002), w * rng.uniform(0.7, 1.3), h * rng.uniform(0.8, 1.2)
            rows.append((source, k, rng.random() < 0.3, x, y, x + w, y + h))
    rows.append(("a", 900, False, -3.0, 0.5, 4.0, 0.51))  # far beyond the canvas
    df = spark.createDataFrame(rows, SCHEMA).filter("source IS NOT NULL")
    got = {(r.source, r.id): r.field for r in fields.clusters(df, ["source"], 0.25).collect()}
    tasks = fields.neighbourhoods(df, ["source"], 1.0, 1.0).groupBy("source", "part").count().collect()
    for source in ("a", "b", "one"):
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[2], r[1]))
        of = fields.gathered([r[3:] for r in own], 0.25)
        first = {}
        for r, k in zip(own, of):
            first.setdefault(k, r[1])
        assert {r[1]: first[k] for r, k in zip(own, of)} == {i: f for (s, i), f in got.items() if s == source}
    assert len([t for t in tasks if t["source"] == "b"]) > 1
    boxes = {(r.source, r.field): r for r in fields.field_boxes(fields.clusters(df, ["source"], 0.25), ["source"]).collect()}
    for (source, field), r in boxes.items():
        own = [x for x in rows if x[0] == source and got[source, x[1]] == field]
        exact = [x for x in own if not x[2]] or own
        assert r.n == len(own) and [r.x0, r.y0, r.x1, r.y1] == [sorted(x[k] for x in own)[len(own) // 2] for k in (3, 4, 5, 6)]
        assert (r.union_x0, r.union_y1) == (min(x[3] for x in exact), max(x[6] for x in exact))


def test_middle_inside_and_ties():
    a, b = (0.0, 0.0, 1.0, 1.0), (2.0, 0.0, 3.0, 1.0)
    # a small box inside joins by its middle; one between two equal clusters the first; one apart begins its own
    assert fields.gathered([a, b, (0.5, 0.0, 2.5, 1.0), (9.0, 9.0, 9.5, 9.5)], 0.2) == [0, 1, 0, 2]
    assert fields.gathered([a, b, (0.4, 0.4, 0.5, 0.5)], 0.2) == [0, 1, 0] and fields.gathered([a, b, (0.4, 0.4, 0.5, 0.5)], 0.6) == [0, 1, 2]
    assert fields.gathered([], 0.2) == [] and fields.gathered([(0.0, 0.0, 0.0, 0.0)] * 2, 0.3) == [0, 0]


def test_bounds_that_meet_are_one():
    import numpy as np

    got = fields.merged_bounds(np.array([[0, 0, 2, 8], [5, 5, 6, 6], [2, 7, 6, 8], [9, 0, 10, 1]]))
    assert got.tolist() == [0, 0, 0, 3]  # the first two meet only by way of the third's bounds
