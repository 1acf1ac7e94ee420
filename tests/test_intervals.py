"""Interval algebra against a set of whole seconds, and golden values."""

import random

from pyspark.sql import functions as F

from tidemark.operators import intervals


def _sets(rows):
    out = {}
    for g, a, b in rows:
        out.setdefault(g, set()).update(range(int(a), int(b)))
    return out


def test_merge_and_subtract_equal_sets(spark):
    rng = random.Random(3)
    span = lambda n: [(g, float(a := rng.randint(0, 80)), float(a + rng.randint(1, 9))) for g in range(6) for _ in range(n)]
    spans, holes = span(8), span(5)
    s, h = (spark.createDataFrame(x, "g int, a double, b double") for x in (spans, holes))
    merged = intervals.merge(s, ["g"])
    rows = [tuple(r) for r in merged.collect()]
    assert _sets(rows) == _sets(spans)
    for g in range(6):
        own = sorted(r[1:] for r in rows if r[0] == g)
        assert all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False))  # disjoint, not touching
    left = _sets([tuple(r) for r in intervals.subtract(merged, h, ["g"]).collect()])
    assert left == {g: x for g in range(6) if (x := _sets(spans)[g] - _sets(holes)[g])}


def test_touching_spans_join_and_touching_holes_do_nothing(spark):
    s = spark.createDataFrame([(0, 0.0, 2.0), (0, 2.0, 3.0), (0, 3.5, 4.0)], "g int, a double, b double")
    assert sorted(tuple(r) for r in intervals.merge(s, ["g"]).collect()) == [(0, 0.0, 3.0), (0, 3.5, 4.0)]
    assert len(intervals.merge(s, ["g"], 0.5).collect()) == 1
    h = spark.createDataFrame([(0, 4.0, 5.0)], "g int, a double, b double")
    assert sorted(tuple(r) for r in intervals.subtract(s, h, ["g"]).collect()) == sorted(tuple(r) for r in s.collect())


def test_empty(spark):
    e = spark.createDataFrame([], "g int, a double, b double")
    assert intervals.merge(e, ["g"]).count() == intervals.subtract(e, e, ["g"]).count() == 0


def test_edge_trim_golden(spark):
    df = spark.createDataFrame([([True] * 6 + [False] * 30,)], "f array<boolean>")
    front, back = intervals.edge_trims(F.col("f"), 2.0, F.lit(18.0), F.lit(3.0))
    assert tuple(df.select(front, back).first()) == (3.0, 0.0)


def test_frame_plan_golden(spark):
    df = spark.createDataFrame([("x", 10.01, 20.49), ("x", 20.5, 25.0), ("x", 100.0, 104.02)], "g string, a double, b double")
    assert sorted((r.first_frame, r.frames) for r in intervals.snapped(df, ["g"], 30, 1).collect()) == [(300, 450), (3000, 121)]


def test_fold_of_two_teams(spark):
    df = spark.createDataFrame([(0, 0.0, 5.0, "a"), (0, 4.0, 8.0, "a"), (0, 7.0, 12.0, "b"), (0, 11.9, 12.2, "a"), (0, 20.0, 22.0, "a")], "g int, a double, b double, team string")
    got = sorted(tuple(r)[1:] for r in intervals.fold_clips(df, ["g"]).collect())
    assert got == [(0.0, 8.0, "a", 2), (8.0, 12.0, "b", 1), (20.0, 22.0, "a", 1)]


def test_subtract_keeps_equal_spans(spark):
    s = spark.createDataFrame([(1, 0.0, 10.0), (1, 0.0, 10.0), (2, 0.0, 1.0)], "g int, a double, b double")
    h = spark.createDataFrame([(1, 2.0, 3.0)], "g int, a double, b double")
    assert sorted(tuple(r) for r in intervals.subtract(s, h, ["g"]).collect()) == [(1, 0.0, 2.0), (1, 0.0, 2.0), (1, 3.0, 10.0), (1, 3.0, 10.0), (2, 0.0, 1.0)]
