"""Games of each sport end to end, on hand-made displays."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import sequence
from tidemark.plans import adapters, clips, rules
from tidemark.plans import timeline as tl
from tidemark.sources import files


def samples(spark, rows, game="g"):
    """Rows of texts by field, half a second apart; None hides the display."""
    out = []
    for i, texts in enumerate(rows):
        fields = {k: (v, 0.9) for k, v in (texts or {}).items()}
        out.append((game, i, i / 2, texts is not None, 1.0, fields))
    return spark.createDataFrame(out, files.SAMPLES)


def spans(row):
    return [(s.a, s.b) for s in row.segments]


def baseball(count, inning="BOT 9"):
    """A minute: three all, then the home side's fifth run shows at 46 s."""
    return [{"period": inning, "away_score": "3", "home_score": "3" if k < 92 else "5", "count": count(k / 2)} for k in range(120)]


@pytest.mark.parametrize(
    ("count", "cause", "want", "changes"),
    [
        (lambda t: "0-0" if t < 25 else "0-1", "final_pitch", (22.0, 48.0), [25.0]),
        (lambda t: "", "12s_before", (31.0, 48.0), []),
        (lambda t: "0-0" if t < 2 else "0-2", "12s_before", (31.0, 48.0), [2.0]),  # fouls leave it as it is: too long ago
        (lambda t: "0-0" if t < 25 or t >= 46 else "0-1", "final_pitch", (22.0, 48.0), [25.0, 46.0]),  # the next batter's is no pitch
        (lambda t: "1-1" if t == 30 else "0-0" if t < 25 else "0-1", "final_pitch", (22.0, 48.0), [25.0]),  # read once: no change
    ],
)
def test_baseball_counts_place_the_final_pitch(spark, count, cause, want, changes):
    sport = tl.SPORTS["baseball"]
    line = tl.build(samples(spark, baseball(count)), sport).cache()
    assert [r.t for r in tl.text_changes(line, "count").orderBy("t").collect()] == changes
    ev = tl.score_events(line, sport).cache()
    (change,) = ev.collect()
    assert (change.t, change.team, change.points, change.period, change.clock) == (46.0, "home", 2, 18, None)
    (clip,) = clips.build(line, ev, sport, "home").collect()
    assert (clip.kind, clip.points, clip.cause) == ("run", 2, cause) and spans(clip) == [want]


def test_innings_run_without_a_clock(spark):
    rows = [{"period": p, "away_score": a, "home_score": "0"} for p, a, n in (("▲5", "1", 10), ("▲5", "2", 10), ("▼5", "2", 10), ("TOP 6", "2", 10)) for _ in range(n)]
    rows[23]["period"] = "▲2"  # misread
    sport = tl.SPORTS["baseball"]
    line = tl.build(samples(spark, rows), sport).cache()
    got = line.orderBy("i").collect()
    assert [r.period for r in got] == [9] * 20 + [10] * 10 + [11] * 10 and all(r.live and r.clock is None for r in got)
    ev = tl.score_events(line, sport)
    assert [(r.team, r.points, r.period, r.clock) for r in ev.collect()] == [("away", 1, 9, None)]
    asked = spark.createDataFrame([("g", "away", "game_time", 10, None, "end", None, None)], "game_id string, follow string, start_mode string, start_period int, start_clock double, end_mode string, end_period int, end_clock double")
    (r,) = rules.windows(asked, line, ev, sport, 0.5).collect()
    assert (r.t_min, r.start_label) == (10.0, "Bot 5")
    text = tl.title(F.lit(None).cast("string"), F.lit(1), F.lit(9), F.lit(None).cast("double"), F.lit(2), F.lit(0), sport)
    assert spark.range(1).select(text).first()[0] == "Top 5 · +1 · 2-0"


def test_football_clocks_without_minutes(spark):
    # the clock runs down to 42 s before the end, drops its minutes, and stands there; it starts again 8 s before the score
    def clock(t):
        left = 70 - int(t) if t < 28 else 42 if t < 40 else 42 - int(t - 39.5)
        return f"1:{left - 60:02d}" if left >= 60 else f":{left:02d}"

    rows = [{"period": "4th", "clock": clock(k / 2), "away_score": "0", "home_score": "0" if k < 96 else "6", "shot_clock": "", "down_distance": " 3rd & 7 "} for k in range(120)]
    sport = tl.SPORTS["football"]
    line = tl.build(samples(spark, rows), sport).cache()
    got = line.orderBy("i").collect()
    assert all(r.clock is not None for r in got) and got[60].clock == 42.0 and got[0].extra == {"down_distance": "3rd & 7"}
    ev = tl.score_events(line, sport).cache()
    (clip,) = clips.build(line, ev, sport, "home").collect()
    assert clip.kind == "touchdown" and clip.cause == "clock_start"
    # under a minute a clock is taken to show tenths: it started within the sample before its fall shows at 40.5 s
    assert clip.segments[0].a + sport.rolls[0] == pytest.approx(40.2)


def display(clock, shot, home=lambda t: 10, away=lambda t: 8, n=120):
    rows = []
    for k in range(n):
        t = k / 2
        left = clock(t)
        rows.append({"period": "4th", "clock": f"{int(left) // 60}:{int(left) % 60:02d}" if left >= 60 else f"{left:.1f}", "shot_clock": shot(t), "home_score": str(home(t)), "away_score": str(away(t))})
    return rows


def test_switched_off_shot_clock_begins_a_possession(spark):
    """With 23 s left the other side gets the ball: nothing but the blank shot clock says so."""
    sport = tl.SPORTS["basketball"]
    rows = display(lambda t: 53 - t, lambda t: str(12 - int(t % 12)) if t < 30 else "", home=lambda t: 10 if t < 44 else 12, n=100)
    line = tl.build(samples(spark, rows), sport).cache()
    assert [r.t for r in clips.switched_off(line, sport, 0.5).collect()] == [29.75]
    ev = tl.score_events(line, sport).cache()
    (clip,) = clips.build(line, ev, sport, "home").collect()
    assert clip.cause == "shot_clock" and spans(clip) == [(29.75 - sport.rolls[0], 44.0 + sport.rolls[1])]
    # more time left than the shot clock's largest value: it is only unread
    early = tl.build(samples(spark, display(lambda t: 400 - t, lambda t: "6" if t < 30 else "")), sport)
    assert clips.switched_off(early, sport, 0.5).count() == 0
    # hidden or read again within two seconds: no sign
    again = tl.build(samples(spark, display(lambda t: 53 - t / 2, lambda t: "" if 30 <= t < 31.5 else "6")), sport)
    assert clips.switched_off(again, sport, 0.5).count() == 0


LINE = "game_id string, i int, t double, clock double, shot double, live boolean"


def starts(spark, rows, fresh=(24.0, 14.0)):
    df = spark.createDataFrame([("g", i, i / 2, c, s, True) for i, (c, s) in enumerate(rows)], LINE)
    return [(r.at, r.stopped_for) for r in sequence.clock_starts(df, ["game_id"], ["i"], "clock", "shot", "t", "live", 0.5, fresh).orderBy("at").collect()]


def test_start_is_bounded_by_both_clocks(spark):
    before = [(300.0 - int(k / 2), None) for k in range(10)]
    stop = [(295.0, 20.0)] * 12  # shown from 5 s to 10.5 s
    after = [(294.0, 20.0), (294.0, 19.0), (293.0, 19.0), (293.0, 18.0)]
    # the clock alone: between 9.5 and 11; the shot clock's fall at 11.5 says after 10
    assert starts(spark, before + stop + after) == [(10.5, 5.5)]
    late = [(294.0, 20.0)] * 3 + [(293.0, 19.0), (293.0, 18.0)]
    # a fall at 12.5 says after 11: both together leave nothing between, so half a second before
    assert starts(spark, before + stop + late) == [(10.5, 5.5)]
    early = [(294.0, 19.0), (294.0, 19.0), (293.0, 18.0)]
    assert starts(spark, before + stop + early) == [(10.5, 5.5)]


def test_fresh_value_is_exact(spark):
    before = [(300.0 - int(k / 2), None) for k in range(10)]
    fresh = before + [(295.0, 24.0)] * 12 + [(295.0, 24.0), (294.0, 24.0), (294.0, 23.0), (293.0, 23.0)]
    # the clock's fall at 11.5; 24 stood a full second until 12: between 10.5 and 11
    assert starts(spark, fresh) == [(11.0, 6.0)]
    assert starts(spark, fresh, fresh=()) == [(11.0, 6.0)]
    tenths = before + [(45.0, None)] * 12 + [(44.8, None), (44.3, None)]
    assert starts(spark, tenths) == [(10.7, 5.5)]


def test_shorter_hold_where_the_stop_was_not_seen(spark):
    held = lambda n: [(295.0, None)] * n + [(294.0, None), (293.0, None), (292.0, None)]
    assert len(starts(spark, held(4))) == 1  # from the first sample on: 1.5 s are enough
    running = [(300.0 - k, None) for k in range(5)]
    assert starts(spark, running + held(4)) == []  # seen running before: 2.4 s are needed
    assert len(starts(spark, running + [(None, None)] * 5 + held(4))) == 1  # back after a break
    assert starts(spark, [(295.0, None)] * 2 + [(294.0, None), (293.0, None)]) == []


def test_readings_of_all_sports_in_one_table(spark):
    texts = {"period": "OT", "clock": ":42", "shot_clock": "30", "home_score": "7", "count": " 3-2 "}
    rows = [(s, s, 0, 0.0, True, {k: (v, 0.9) for k, v in texts.items()}) for s in ("basketball", "football", "hockey", "baseball", "cricket", None)]
    rows.append(("baseball", "late", 0, 0.0, True, {"period": ("▼5", 0.9), "clock": ("1:00", 0.9), "count": ("1-1", 0.1)}))
    rows.append(("hockey", "hidden", 0, 0.0, False, {"period": ("1st", 0.9)}))
    df = spark.createDataFrame(rows, "sport string, game_id string, i int, t double, visible boolean, fields map<string, struct<text: string, conf: float>>")
    got = {r.game_id: (r.period, r.clock, r.shot_clock, r.home_score, r.texts, r.game_seconds) for r in adapters.typed(df).collect()}
    note = {"count": "3-2"}
    assert got["basketball"] == (5, None, None, 7, note, None) and got["football"] == (5, 42.0, 30.0, 7, note, 4 * 900.0 + 558.0)
    assert got["hockey"] == (4, None, None, 7, note, None) and got["baseball"] == (None, None, None, 7, note, None)
    assert got["cricket"][3] == 7 and got[None][3] == 7  # an unknown sport keeps what needs no rule
    assert got["late"] == (10, None, None, None, {}, 10.0) and got["hidden"] == (None, None, None, None, {}, None)


def test_plays_of_all_sports_start_by_their_own_sign(spark):
    changes = spark.createDataFrame([("f", "football", 100.0), ("h", "hockey", 100.0), ("b", "baseball", 100.0), ("b", "baseball", 300.0)], "game_id string, sport string, t double")
    signs = spark.createDataFrame([(g, at, s) for g in "fhb" for at, s in ((84.0, "clock"), (75.0, "count"), (100.0, "clock"), (100.0, "count"))], "game_id string, at double, sign string")
    got = {(r.game_id, r.t): (r.start, r.cause, r.a, r.b) for r in adapters.play_starts(changes, signs).collect()}
    assert got == {("f", 100.0): (84.0, "clock_start", 82.0, 102.0), ("h", 100.0): (85.0, "15s_before", 84.0, 102.0), ("b", 100.0): (75.0, "final_pitch", 72.0, 102.0), ("b", 300.0): (288.0, "12s_before", 285.0, 302.0)}


@pytest.mark.parametrize(("text", "half"), [("TOP 5", 9), ("BOT 5", 10), ("▲5", 9), ("5 ▼", 10), ("5th", 9), ("MID 5", 10), ("T10", 19), ("FINAL", None), ("45", None), ("3-2", None)])
def test_half_innings_by_reader(spark, text, half):
    assert spark.range(1).select(parse.period_by(F.lit("inning"), F.lit(text), F.lit(9))).first()[0] == half
