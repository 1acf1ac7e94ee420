"""Rules by sport on small tables: kinds, starts, snaps and windows."""

from pyspark.sql import functions as F

from tidemark.plans import rules
from tidemark.plans.timeline import SPORTS


def test_kinds(spark):
    rows = [(2, True, 9.0, None), (2, True, 2.0, []), (1, None, None, None), (3, True, 9.0, ["free_throw", None]), (2, False, 0.0, ["touchdown", "safety"]), (2, False, 0.0, None), (7, False, 0.0, ["home_run"])]
    df = spark.createDataFrame(rows, "p int, s boolean, d double, m array<string>")
    got = df.select(*(rules.kind(n, F.col("p"), F.col("s"), F.col("d"), F.col("m")).alias(n) for n in ("basketball", "football", "hockey", "baseball"))).collect()
    assert [r.basketball for r in got] == ["free_throws", "field_goal", "free_throws", "free_throws", "field_goal", "field_goal", "field_goal"]
    assert [r.football for r in got] == ["two_point", "two_point", "extra_point", "field_goal", "safety", "safety", "touchdown"]
    assert {r.hockey for r in got} == {"goal"} and [r.baseball for r in got] == ["run"] * 6 + ["home_run"]


def test_last_sign_is_strictly_before(spark):
    changes = spark.createDataFrame([("g", 1, 100.0), ("g", 2, 140.0), ("g", 3, 155.0), ("h", 1, 50.0)], "game_id string, event_index int, t double")
    signs = spark.createDataFrame([("g", 85.0), ("g", 100.0), ("g", 140.0)], "game_id string, at double")
    got = rules.last_sign(changes, signs, ["game_id"], 15.0, 12.0, "faceoff", "before").orderBy("game_id", "event_index").collect()
    assert [(r.start, r.cause) for r in got] == [(85.0, "faceoff"), (128.0, "before"), (140.0, "faceoff"), (38.0, "before")]
    assert rules.last_sign(changes.limit(0), signs, ["game_id"], 15.0, 12.0, "a", "b").count() == 0


def test_snaps(spark):
    changes = spark.createDataFrame([("g", 0, 1, 30.0, 600.0), ("g", 1, 1, 30.0, 500.0), ("g", 2, 2, 30.0, 600.0), ("g", 3, 1, 5.0, 600.4), ("g", 4, 1, 30.0, None)], "game_id string, event_index int, period int, t double, snap double")
    shown = spark.createDataFrame([("g", 1, float(k), 610.0 - k) for k in range(0, 40)] + [("g", 1, 9.5, 600.5)], "game_id string, period int, t_video double, clock double")
    got = {r.event_index: r.snap_t for r in rules.snap_times(changes, shown).collect()}
    assert got == {0: 10.0, 1: None, 2: None, 3: None, 4: None}


def test_windows(spark):
    games = ("timed", "late", "play", "clock", "shown", "never", "whole")
    timeline = spark.createDataFrame([(g, float(t), True, 720.0 - t, 1) for g in games for t in range(0, 200)], "game_id string, t_video double, live boolean, clock double, period int")
    theirs = [(g, "away", 60.0, 1, 660.0, 0, 5) for g in games if g != "never"] + [(g, "away", 90.0, 1, 630.0, 2, 7) for g in games if g != "never"] + [(g, "home", 100.0, 1, 620.0, 4, 7) for g in games]
    events = spark.createDataFrame(theirs, "game_id string, team string, t double, period int, clock double, score_home int, score_away int")
    asked = spark.createDataFrame(
        [
            ("timed", "home", "game_time", 1, 700.0, "game_time", 1, 600.0), ("late", "home", "game_time", 3, None, "game_time", 4, 0.0), ("play", "home", "auto_run", None, None, "end", None, None),
            ("clock", "home", "auto_run", None, None, "end", None, None), ("shown", "home", "auto_run", None, None, "end", None, None), ("never", "home", "auto_run", None, None, "end", None, None), ("whole", "home", "start", None, None, "end", None, None),
        ],
        "game_id string, follow string, start_mode string, start_period int, start_clock double, end_mode string, end_period int, end_clock double",
    )
    runs = spark.createDataFrame([("play", 1, 650.0, 9, 72.0), ("clock", 1, 650.0, 9, None), ("shown", 4, 10.0, 9, None)], "game_id string, run_period int, run_clock double, run_deficit int, run_t double")
    got = {r.game_id: r for r in rules.windows(asked, timeline, events, SPORTS["basketball"], 0.5, runs).collect()}
    assert {g: (got[g].t_min, got[g].t_max) for g in games} == {"timed": (20.0, 122.5), "late": (None, None), "play": (72.25, None), "clock": (70.25, None), "shown": (90.25, None), "never": (None, None), "whole": (None, None)}
    assert (got["timed"].start_label, got["timed"].end_label) == ("Q1 11:40", "Q1 10:00") and got["late"].start_label == "Start of game"
    assert got["play"].start_label == "Biggest run: down 9 at Q1 10:50" and got["shown"].start_label == "Biggest run: down 5 at Q1 10:30"
    assert {g: len(got[g].notes) for g in games} == {"timed": 0, "late": 2, "play": 0, "clock": 0, "shown": 1, "never": 1, "whole": 0}
    assert rules.windows(asked, timeline, events, SPORTS["basketball"], 0.5).filter("t_min = 90.25").count() == 3
