"""Matching in turns, one-letter codes and one-to-one overlaps, against plain versions."""

import random

from pyspark.sql import functions as F

from tidemark.operators import alignment
from tidemark.plans import catalogue

CHANGES = "g int, change_id long, before int, after int, points int, period int, clock double"
PLAYS = "g int, play_id long, score int, points int, period int, clock double"


def _taken(changes, plays, tolerance, late):
    """Every candidate of every turn, sorted, then first come first served."""
    wanted = []
    for c in changes:
        way = [max((p for p in plays if p[2] == s), key=lambda p: p[1]) for s in range(c[2] + 1, c[3] + 1) if any(p[2] == s for p in plays)]
        if way and sum(p[3] for p in way) == c[4] and c[5] in (None, way[-1][4]):
            d = None if c[6] is None or way[-1][5] is None else abs(c[6] - way[-1][5])
            if d is None or d <= late:
                wanted.append((1 if d is not None and d <= tolerance else 3, c[1], -1 if d is None else d, 0, [p[1] for p in way], d))
        for p in plays:
            if p[3] == c[4] and c[5] in (None, p[4]) and c[6] is not None and p[5] is not None and abs(c[6] - p[5]) <= tolerance + 1e-6:
                d = abs(c[6] - p[5])
                wanted.append((2, c[1], d, -p[1], [p[1]], d))
    owners, gone, out = set(), set(), set()
    for turn, who, _, _, what, d in sorted(wanted, key=lambda x: x[:4]):
        if who not in owners and not gone & set(what):
            owners.add(who)
            gone |= set(what)
            out.add((who, tuple(what), "merged" if len(what) > 1 else "score" if turn == 3 else "clock", d))
    return out


def test_greedy_match(spark):
    deal = random.Random(3)
    changes, plays = [], []
    for g in range(12):
        score = 0
        for k in range(deal.randint(0, 25)):
            points = deal.randint(1, 3)
            score += points
            plays.append((g, k, None if deal.random() < 0.1 else score, points, deal.randint(1, 2), None if deal.random() < 0.1 else float(deal.randint(0, 60))))
        for k in range(deal.randint(0, 25)):
            before = deal.randint(0, 30)
            points = deal.randint(-1, 5)
            changes.append((g, k, before, before + points, points, deal.choice([None, 1, 2]), None if deal.random() < 0.2 else float(deal.randint(0, 60))))
    got = alignment.greedy_match(spark.createDataFrame(changes, CHANGES), spark.createDataFrame(plays, PLAYS), ["g"], 3.0, 30.0).collect()
    for g in range(12):
        want = _taken([c for c in changes if c[0] == g], [p for p in plays if p[0] == g], 3.0, 30.0)
        assert {(r.change_id, tuple(r.play_ids), r.how, r.clock_diff) for r in got if r.g == g} == want


def test_same_code_join(spark):
    codes = ["NY", "NYK", "N", "nyx", "BOS", "BO", "B", "", "Q"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    from tidemark.functions.parse import same_code

    pairs = df.select(F.col("c").alias("x")).crossJoin(df.select(F.col("c").alias("y"))).filter(same_code(F.col("x"), F.col("y")) & (F.trim("x") != "") & (F.trim("y") != ""))
    got = alignment.same_code_join(df.select(F.col("c").alias("x")), df.select(F.col("c").alias("y")), "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))


def test_best_overlap_gives_each_once(spark):
    box = lambda a, b: {"x0": a, "y0": 0.0, "x1": b, "y1": 1.0}
    schema = "g int, id int, box struct<x0: double, y0: double, x1: double, y1: double>"
    left = spark.createDataFrame([(1, 1, box(0.0, 0.4)), (1, 2, box(0.1, 0.5)), (1, 3, box(0.9, 1.0))], schema)
    right = spark.createDataFrame([(1, 7, box(0.1, 0.5)), (1, 8, box(0.0, 0.2))], schema)
    assert {(r.id, r.other_id) for r in alignment.best_overlap(left, right, ["g"]).collect()} == {(2, 7), (1, 8)}


def test_summary_reads_matches_that_were_made_once(spark, sf):
    out = catalogue.QUERIES["match_summary"](spark, sf)
    assert out.inputFiles() and not any("events" in f for f in out.inputFiles())
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
