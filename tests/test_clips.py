"""The clip builder by sport on hand-made games, and the closing fold against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clipping
from tidemark.plans import clips
from tidemark.plans import timeline as tl

LINE = "game_id string, i int, t_video double, period int, clock double, shot_clock double, live boolean"
CHANGE = "game_id string, event_index int, t double, t_prev double, team string, points int, before int, after int, period int, clock double, held double, conf float, score_away int, score_home int, notes array<string>"


def line(spark, seconds, clock=lambda t: 600.0 - int(t), shot=lambda t: None, live=lambda t: True):
    return spark.createDataFrame([("g", i, i / 2, 1, clock(i / 2) if live(i / 2) else None, shot(i / 2) if live(i / 2) else None, live(i / 2)) for i in range(int(2 * seconds))], LINE).cache()


def changes(spark, *rows):
    """Rows (t, team, points, clock, held), in order."""
    score, out = {"home": 0, "away": 0}, []
    for k, (t, team, points, clock, held) in enumerate(rows):
        before = score[team]
        score[team] += points
        out.append(("g", k, t, t - 0.5, team, points, before, score[team], 1, clock, held, 1.0, score["away"], score["home"], []))
    return spark.createDataFrame(out, CHANGE).cache()


def spans(row):
    return [(s.a, s.b) for s in row.segments]


def test_both_sides_are_cut_where_they_meet(spark):
    ev = changes(spark, (20.0, "home", 2, 580.0, 0.0), (40.0, "away", 2, 560.0, 0.0))
    rows = clips.build(line(spark, 60), ev, tl.SPORTS["basketball"], "home", clips.Options(opponent=True)).orderBy("clip").collect()
    assert [(r.team, r.cause, spans(r)) for r in rows] == [("home", "max_length", [(0.0, 21.5)]), ("away", "opponent_score", [(21.5, 41.5)])]
    assert rows[0].confidence == 0.64 and rows[1].confidence == 1.0  # trimmed: a fifth less, twice


def test_free_throw_after_a_basket_rides_on_it(spark):
    stopped = lambda t: 600.0 - int(min(t, 30.0))
    ev = changes(spark, (30.0, "home", 2, 570.0, 0.0), (50.0, "home", 1, 570.0, 20.0), (70.0, "home", 1, 570.0, 40.0))
    build = lambda **o: clips.build(line(spark, 90, stopped), ev, tl.SPORTS["basketball"], "home", clips.Options(**o)).collect()
    (row,) = build()
    assert row.kind == "field_goal" and row.points == 4 and row.changes == [0, 1, 2] and len(row.segments) == 3 and spans(row)[1:] == [(47.0, 51.0), (67.0, 71.0)]
    (row,) = build(and_one=False)
    assert row.points == 2 and len(row.segments) == 1


def test_lone_free_throws_are_one_clip_or_none(spark):
    stopped = lambda t: 600.0 - int(min(t, 20.0))
    ev = changes(spark, (40.0, "home", 1, 580.0, 20.0), (60.0, "home", 1, 580.0, 40.0))
    (row,) = clips.build(line(spark, 90, stopped), ev, tl.SPORTS["basketball"], "home").collect()
    assert row.kind == "free_throws" and row.points == 2 and spans(row) == [(37.0, 41.0), (57.0, 61.0)] and row.cause == "free_throw"
    assert clips.build(line(spark, 90, stopped), ev, tl.SPORTS["basketball"], "home", clips.Options(free_throws=False)).count() == 0


def test_score_after_a_break_ends_where_the_break_began(spark):
    ev = changes(spark, (40.0, "home", 2, 560.0, 0.0)).withColumn("t_prev", F.lit(29.5))
    (row,) = clips.build(line(spark, 60, live=lambda t: not 30 <= t < 40), ev, tl.SPORTS["basketball"], "home").collect()
    assert row.segments[-1].b == 29.5 and row.changes == [0] and row.confidence < 1


def test_reset_of_the_shot_clock_starts_the_clip_and_the_make_ends_it(spark):
    shot = lambda t: 24.0 - int(t - (30 if t >= 30 else 20 if t >= 20 else 0))
    ev = changes(spark, (31.0, "home", 2, 569.0, 0.0))
    (row,) = clips.build(line(spark, 60, shot=shot), ev, tl.SPORTS["basketball"], "home").collect()
    # reset at 20 seen half a step late; made at 30, so the end comes before the usual roll
    assert row.cause == "shot_clock" and spans(row) == [(18.75, 32.25)]


def test_extra_point_rides_on_its_touchdown(spark):
    ev = changes(spark, (40.0, "home", 6, 560.0, 0.0), (70.0, "home", 1, 560.0, 30.0), (90.0, "away", 3, 500.0, 0.0))
    (row,) = clips.build(line(spark, 120), ev, tl.SPORTS["football"], "home").collect()
    assert row.kind == "touchdown" and row.points == 7 and spans(row) == [(26.0, 42.0), (67.0, 71.0)] and row.cause == "12s_before"
    (row,) = clips.build(line(spark, 120), ev, tl.SPORTS["football"], "home", clips.Options(tail=False)).collect()
    assert row.points == 6 and len(row.segments) == 1


def test_final_pitch_and_window_of_times(spark):
    ev = changes(spark, (40.0, "home", 1, None, None), (80.0, "home", 2, None, None))
    counts = spark.createDataFrame([("g", 33.0)], "game_id string, at double")
    rows = clips.build(line(spark, 120), ev, tl.SPORTS["baseball"], "home", counts=counts).orderBy("clip").collect()
    assert [(r.kind, r.cause, spans(r)) for r in rows] == [("run", "final_pitch", [(30.0, 42.0)]), ("run", "12s_before", [(65.0, 82.0)])]
    assert [r.clip for r in clips.build(line(spark, 120), ev, tl.SPORTS["baseball"], "home", t_min=50.0, counts=counts).collect()] == [1]


def test_defensive_play_joins_the_score_it_led_to(spark):
    ev = changes(spark, (40.0, "home", 2, 560.0, 0.0), (10.0, "away", 2, 590.0, 0.0))
    plays = spark.createDataFrame([("g", 30.0, "home", "steal"), ("g", 70.0, "home", "block"), ("g", 50.0, "away", "block")], "game_id string, t double, team string, kind string")
    rows = clips.build(line(spark, 90), ev, tl.SPORTS["basketball"], "home", defense=plays).orderBy(F.col("segments")[0]["a"]).collect()
    assert [r.kind for r in rows] == ["field_goal", "block"] and spans(rows[1]) == [(67.0, 74.0)] and rows[1].points == 0 and rows[0].changes == [0]


def test_empty_game(spark):
    assert clips.build(line(spark, 10), changes(spark, (5.0, "home", 2, 595.0, 0.0)).limit(0), tl.SPORTS["hockey"], "home").count() == 0


def plain_fold(rows, least=0.4):
    """(clip, team, a, b of one segment) in order of a: clip -> (into, a)."""
    out, last = {}, None
    for clip, team, a, b in sorted(rows, key=lambda r: (r[2], r[0])):
        if last and a <= last[2] and team == last[1]:
            out[clip] = (last[0], a)
            last = (last[0], team, max(last[2], b))
        elif last and a <= last[2]:
            if b - last[2] >= least:
                out[clip] = (clip, last[2])
                last = (clip, team, b)
        else:
            out[clip] = (clip, a)
            last = (clip, team, b)
    return out


def test_settle_equals_a_plain_loop(spark):
    rng, rows = random.Random(7), []
    for g in range(30):
        for k in range(12):
            a = rng.randrange(0, 60)
            rows.append((f"g{g}", k, rng.choice(["home", "away"]), float(a), float(a + rng.randrange(1, 12))))
    df = spark.createDataFrame(rows, "game_id string, clip long, team string, a double, b double")
    got = {(r.game_id, r.clip): (r.into, r.a) for r in clipping.settle(df, ["game_id"]).collect()}
    want = {(f"g{g}", c): v for g in range(30) for c, v in plain_fold([r[1:] for r in rows if r[0] == f"g{g}"]).items()}
    assert got == want


@pytest.mark.parametrize("kind,seconds", [("home_run", 5.0), ("run", 0.0)])
def test_longer_at_export(spark, kind, seconds):
    assert spark.range(1).select(clips.extension(F.lit(kind))).first()[0] == seconds
