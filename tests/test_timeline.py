"""A scripted game through the whole flow: states, events, clips, labels and the window's start."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, review, sequence
from tidemark.plans import clips as cut_clips
from tidemark.plans import timeline as tl
from tidemark.sources import files

SPORT = tl.SPORTS["basketball"]


def script():
    """Two minutes at two samples a second: scores at 20, 40, 75 s; the bug hidden at 50-54 s; a replay of the old score at 80-83 s; a lone misread at 60 s."""
    rows = []
    for i in range(240):
        t = i / 2
        home = 10 + 2 * (t >= 20) + 3 * (t >= 75)
        away = 8 + 2 * (t >= 40)
        visible = not 50 <= t < 54
        clock = 600 - int(t)
        if 80 <= t < 83:
            home, clock = 12, 600 - int(t - 8)
        text_home = "52" if t == 60 else str(home)
        fields = {"home_score": (text_home, 0.9), "away_score": (str(away), 0.9), "period": ("1st", 0.9), "clock": (f"{clock // 60}:{clock % 60:02d}", 0.9), "shot_clock": ("", 0.0)}
        rows.append(("g", i, t, visible, 1.0, fields))
    return rows


@pytest.fixture(scope="module")
def timeline(spark):
    return tl.build(spark.createDataFrame(script(), files.SAMPLES), SPORT).cache()


def test_states(timeline):
    rows = timeline.orderBy("i").collect()
    assert {r.t_video for r in rows if r.state == tl.HIDDEN} == {50 + k / 2 for k in range(8)}
    assert {r.t_video for r in rows if r.state == tl.REPLAY} == {80 + k / 2 for k in range(6)}
    assert [rows[i].score_home for i in (0, 39, 40, 120, 149, 150, 162, 239)] == [10, 10, 12, 12, 12, 15, 15, 15]
    assert all(r.confidence == 0 for r in rows if not r.live)


def test_readers_name_a_text_once(spark):
    """A text is looked up once for a reader, so the method that Spark generates stays small enough to be compiled."""
    plan = tl.readings(spark.createDataFrame(script(), files.SAMPLES), SPORT)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[clock].text") <= 2 and plan.count("[period].text") <= 2


def test_not_live_is_widened(timeline):
    spans = sequence.widened(timeline, ["game_id"], ["i"], F.col("live"), "t_video", 0.5)
    assert sorted((r.a, r.b) for r in spans.collect()) == [(49.5, 54.0), (79.5, 83.0)]


def test_events(timeline):
    rows = tl.score_events(timeline, SPORT).orderBy("event_index").collect()
    assert [(r.team, r.t, r.points, r.before, r.after) for r in rows] == [("home", 20.0, 2, 10, 12), ("away", 40.0, 2, 8, 10), ("home", 75.0, 3, 12, 15)]
    assert rows[0].t_prev == 19.5 and rows[0].clock == 580.0 and rows[0].period == 1


def test_clips_leak_nothing(timeline):
    events = tl.score_events(timeline, SPORT)
    clips = cut_clips.build(timeline, events, SPORT, "home").orderBy("clip").collect()
    assert [c.clip for c in clips] == [0, 2] and [c.changes for c in clips] == [[0], [2]]
    assert clips[1].segments[-1].b == 76.5 and clips[1].cause == "bug_returned" and clips[1].segments[0].a == 54.0
    cut = [(s.a, s.b) for c in clips for s in c.segments]
    assert all(b <= 49.5 or a >= 54.0 for a, b in cut) and all(b <= 79.5 or a >= 83.0 for a, b in cut)


def test_labels(spark, timeline):
    events = tl.score_events(timeline, SPORT)
    clips = cut_clips.build(timeline, events, SPORT, "home").cache()
    matches = spark.createDataFrame([("g", 0, [7], "clock", 0.5)], "game_id string, change_id long, play_ids array<long>, how string, clock_diff double")
    plays = spark.createDataFrame([("g", 7, "J. Doe", "layup")], "game_id string, play_id long, scorer string, description string")
    before = {r.clip: r.confidence for r in clips.collect()}
    rows = {r.clip: r for r in tl.labelled(clips, matches, plays).collect()}
    assert rows[0].scorer == "J. Doe" and rows[0].confidence == before[0] and rows[2].confidence == pytest.approx(before[2] * 0.75, abs=1e-3)


def test_quality(timeline):
    r = tl.quality(timeline).first()
    assert (r.samples, r.visible, r.live, r.replay_samples) == (240, 232, 226, 6) and r.clock_unreadable == 0


def test_window_starts_after_the_low_point(spark):
    events = spark.createDataFrame([("g", "away", 10.0, 1, 600.0, 2, 0), ("g", "home", 20.0, 1, 590.0, 2, 2), ("g", "away", 30.0, 1, 580.0, 4, 2), ("g", "away", 40.0, 1, 570.0, 6, 6)], "game_id string, team string, t double, period int, clock double, score_away int, score_home int")
    assert tl.window_start(events, "home", 0.5).first().t_min == 30.25  # the later of two equal deficits


def test_title(spark):
    row = spark.range(1).select(tl.title(F.lit("J. Brunson"), F.lit(3), F.lit(3), F.lit(580.0), F.lit(55), F.lit(81), SPORT)).first()
    assert row[0] == "Q3 9:40 · J. Brunson +3 · 55-81"


def test_cut_list(spark):
    df = spark.createDataFrame([("g", 0, 0.0, 10.0), ("g", 1, 20.0, 24.0), ("g", 2, 30.0, 33.5)], "g string, k int, a double, b double")
    placed = intervals.place_in_cut(df, ["g"], ["k"]).orderBy("k").collect()
    assert [(r.out_start, r.out_end) for r in placed] == [(0.0, 10.0), (10.0, 14.0), (14.0, 17.5)]
    asked = spark.createDataFrame([("g", 0.0), ("g", 12.0), ("g", 15.5)], "g string, offset double")
    assert sorted(r.source_t for r in review.source_time(df, asked, ["g"]).collect()) == [0.0, 22.0, 31.5]
