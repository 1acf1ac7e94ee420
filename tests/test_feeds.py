"""Feed normalisers on documents of each shape, and text and table sinks."""

import json

from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.sources import feeds, files


def write(tmp_path, doc):
    (tmp_path / "a.json").write_text(json.dumps(doc))
    return str(tmp_path / "a.json")


def test_actions(spark, tmp_path):
    a = lambda n, h, w, **k: {"actionNumber": n, "period": 1, "clock": "PT11M42.00S", "teamTricode": "nyk", "scoreHome": str(h), "scoreAway": str(w), "actionType": "2pt", "description": " d ", "playerNameI": "J. B", **k}
    doc = {"game": {"gameId": "g", "actions": [a(1, 2, 0), a(2, 2, 0), a(3, 1, 0), a(4, 2, 3), a(5, 3, 3, actionType="freethrow"), {"actionNumber": 6}, a(7, 5, 4)]}}
    rows = feeds.action_events(feeds.read_json(spark, write(tmp_path, doc), feeds.ACTIONS)).orderBy("event_id").collect()
    assert [(r.event_id, r.side, r.points, r.kind, r.score_home, r.score_away) for r in rows] == [
        ("1", "home", 2, "field_goal", 2, 0), ("4", "away", 3, "field_goal", 2, 3), ("5", "home", 1, "free_throw", 3, 3), ("7", "home", 2, "field_goal", 5, 4),
    ]
    assert rows[0].clock == 702.0 and rows[0].team == "NYK" and rows[0].description == "d"


def test_summary(spark, tmp_path):
    play = lambda i, h, w, team, text: {"id": i, "scoringPlay": True, "homeScore": h, "awayScore": w, "team": {"id": team}, "type": {"text": "Jump Shot"}, "text": text, "period": {"number": 2}, "clock": {"displayValue": "9:40"}}
    doc = {"id": "g", "header": {"competitions": [{"competitors": [{"homeAway": "home", "team": {"id": "1", "abbreviation": "NY"}}, {"homeAway": "away", "team": {"id": "2", "abbreviation": "SA"}}]}]},
           "plays": [play("x", 2, 0, "1", "Jalen Brunson makes layup"), {"id": "n", "scoringPlay": False}, play("y", 2, 1, "9", "A B makes free throw 1 of 2")]}
    rows = feeds.summary_events(feeds.read_json(spark, write(tmp_path, doc), feeds.SUMMARY)).orderBy("event_id").collect()
    assert [(r.event_id, r.team, r.points, r.scorer, r.kind, r.clock) for r in rows] == [("x", "NYK", 2, "J. Brunson", "field_goal", 580.0), ("y", "SAS", 1, "A. B", "free_throw", 580.0)]


def test_season_kinds(spark):
    rows = [("g", i, 1, 900 - i, h, a, n) for i, (h, a, n) in enumerate([(0, 2, ""), (6, 2, "X"), (6, 4, "Z"), (12, 4, "Y"), (14, 4, ""), (17, 4, "K")])]
    df = spark.createDataFrame(rows, "game_id string, play_id int, qtr int, quarter_seconds_remaining int, total_home_score int, total_away_score int, td_player_name string")
    df = df.withColumn("kicker_player_name", F.when(F.col("play_id") == 5, "Foot")).withColumn("safety", F.lit(0)).withColumn("two_point_attempt", F.lit(0))
    out = feeds.season_events(df).orderBy("event_id").collect()
    assert [r.kind for r in out] == ["safety", "touchdown", "two_point", "touchdown", "two_point", "field_goal"]
    assert [r.scorer for r in out] == ["", "X", "", "Y", "", "Foot"] and [r.side for r in out][:2] == ["away", "home"]


def test_goals(spark):
    rows = [("g", 1, 10, 1, "REG", 100.0, "home", 1, 0, 7), ("g", 2, 11, 1, "REG", 90.0, "away", None, None, 8), ("g", 3, 12, 2, "REG", 80.0, "home", 1, 1, 7), ("g", 4, 13, 5, "SO", 0.0, "home", 2, 1, 7)]
    df = spark.createDataFrame(rows, "game_id string, sort_order int, event_id bigint, period int, period_type string, seconds_left double, owner string, home int, away int, player_id bigint")
    names = spark.createDataFrame([("g", 7, "A. One")], "game_id string, player_id bigint, scorer string")
    out = feeds.goal_events(df, names).orderBy("event_id").collect()
    assert [(r.event_id, r.side, r.points, r.score_home, r.score_away, r.scorer) for r in out] == [(10, "home", 1, 1, 0, "A. One"), (11, "away", 1, 1, 1, None)]


def test_sidecar_sides(spark, tmp_path):
    ev = lambda i, team, h, w, **k: {"event_id": i, "team": team, "score_home": h, "score_away": w, **k}
    doc = {"away": "SAS", "home": "NYK", "events": [ev("1", "NYK", 2, 0), ev("2", "?", 2, 3), ev("3", "?", 4, 3), ev("4", "?", 4, 3, extra={"side": "away"})]}
    rows = feeds.sidecar_events(feeds.read_json(spark, write(tmp_path, doc), feeds.SIDECAR)).orderBy("at").collect()
    assert [r.side for r in rows] == ["home", "away", "home", "away"]
    (tmp_path / "a.json").write_text("{broken")
    assert feeds.sidecar_events(feeds.read_json(spark, str(tmp_path / "a.json"), feeds.SIDECAR)).count() == 0


def test_schedule(spark, tmp_path):
    c = lambda side, code, s: {"homeAway": side, "score": s, "team": {"abbreviation": code, "displayName": code}}
    doc = {"events": [{"id": "1", "competitions": [{"status": {"type": {"description": "Final"}}, "notes": [{"headline": "Game 4"}], "competitors": [c("home", "NY", "100"), c("away", "SA", "x")]}]}]}
    docs = feeds.read_json(spark, write(tmp_path, doc), feeds.SCHEDULE)
    row = feeds.schedule_games(docs, "NYK").first()
    assert (row.home, row.away, row.home_score, row.away_score, row.status, row.label) == ("NYK", "SAS", 100, None, "Final", "Game 4")
    assert feeds.schedule_games(docs, "BOS").count() == 0


def test_games_by_teams_and_by_days(spark, tmp_path):
    t = lambda code, s: {"teamTricode": code, "teamCity": "City", "teamName": code.lower(), "score": s}
    games = [{"gameId": "7", "gameStatusText": "Final ", "gameLabel": "Finals", "gameSubLabel": "", "seriesText": "2-1", "homeTeam": t("NYK", 90), "awayTeam": t("SAS", 88)}, {"gameId": "8"}]
    found = feeds.board_games(feeds.read_json(spark, write(tmp_path, {"scoreboard": {"games": games}}), feeds.BOARD))
    a, b = found.orderBy("game_id").collect()
    assert (a.home, a.away_name, a.home_score, a.status, a.label) == ("NYK", "City sas", 90, "Final", "Finals · 2-1") and (b.home, b.home_name, b.home_score, b.label) == ("", "", None, "")
    assert feeds.board_games(feeds.read_json(spark, write(tmp_path, {"scoreboard": {"games": games}}), feeds.BOARD), "sas").count() == 1
    side = lambda code, s: {"score": s, "team": {"abbreviation": code, "name": code}}
    late = {"gamePk": 1, "gameType": "W", "status": {"detailedState": "Final"}, "teams": {"home": side("LAD", 5), "away": side("TOR", 4)}, "linescore": {"currentInning": 11}, "seriesDescription": "World Series", "seriesGameNumber": 7}
    plain = {"gamePk": 2, "gameType": "R", "status": {"abstractGameState": "Live"}, "linescore": {"currentInning": 3}, "seriesDescription": "Regular Season", "seriesGameNumber": 2, "doubleHeader": "Y", "gameNumber": 1}
    docs = feeds.read_json(spark, write(tmp_path, {"dates": [{"games": [late]}, {"games": [plain]}, {}]}), feeds.DAYS)
    a, b = feeds.day_games(docs).orderBy("game_id").collect()
    assert (a.home, a.away_score, a.status, a.label) == ("LAD", 4, "Final/11", "World Series · Game 7") and (b.home, b.status, b.label) == ("", "Live", "Doubleheader game 1")
    assert feeds.day_games(docs, "TOR").count() == 1


def test_times_at_bat(spark, tmp_path):
    p = lambda a, h, inning, half, kind, at=None: {"result": {"awayScore": a, "homeScore": h, "eventType": kind, "description": " d ", "rbi": 1}, "about": {"inning": inning, "halfInning": half, "atBatIndex": at}, "matchup": {"batter": {"fullName": "A B"}}}
    plays = [p(0, 0, 1, "top", "out", 0), p(2, 0, 1, "top", "home_run", 1), p(None, 0, 1, "top", "out", 2), p(1, 0, 2, "top", "out", 3), p(2, 1, 5, "bottom", "single", 4), p(3, 1, None, "top", "single"), {}]
    docs = feeds.read_json(spark, write(tmp_path, {"allPlays": plays}), feeds.AT_BATS).withColumn("game_id", F.lit("1"))
    games = spark.createDataFrame([("1", "LAD", "TOR")], "game_id string, home string, away string")
    found = feeds.at_bat_events(docs, games).orderBy("event_id", "period").collect()
    assert [(r.event_id, r.period, r.team, r.points, r.score_away, r.score_home, r.kind) for r in found] == [("1", 1, "TOR", 2, 2, 0, "home_run"), ("2", 0, "TOR", 1, 3, 1, "run"), ("4", 10, "LAD", 1, 2, 1, "run")]
    assert all(r.scorer == "A B" and r.description == "d" and r.clock is None for r in found)
    assert feeds.at_bat_events(docs.limit(0), games).count() == 0


def test_defense(spark):
    df = spark.createDataFrame([("Late turnover (Josh Hart steals)", ""), ("Mitchell Robinson blocks the layup", ""), ("bad pass STEAL by", ""), ("x", "Block"), ("BLOCK", "2pt"), (None, None)], "t string, k string")
    assert [(r.p.player, r.p.kind) for r in df.select(feeds.described_defense(F.col("t")).alias("p")).collect()] == [("J. Hart", "steal"), ("M. Robinson", "block"), (None, None), (None, None), (None, None), (None, None)]
    assert sorted(r.defense for r in feeds.defensive_plays(df, "t", "k").collect()) == ["block", "steal"]


def test_tables_round_trip(spark, tmp_path):
    rows = [("g", i, i / 2, True, 1.0, {"clock": ("9:5" + str(i), 0.5), "period": ("1st", 0.25)}) for i in range(4)]
    df = spark.createDataFrame(rows, files.SAMPLES)
    files.write_entities(files.wide_samples(df, ["clock", "period"]), str(tmp_path / "s"))
    back = files.narrow_samples(spark.read.parquet(str(tmp_path / "s")))
    assert sorted(str(r) for r in back.collect()) == sorted(str(r) for r in df.collect())
    nan = spark.createDataFrame([("g", float("nan"))], "game_id string, x double")
    files.write_entities(nan, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).first().x is None


def test_lines_and_chapters(spark, tmp_path):
    df = spark.createDataFrame([("g", 0.0, 10.0, "a=b"), ("g", 10.0, 10.001, "gone"), ("g", 10.0, 17.5, "c;d")], "game_id string, a double, b double, t string")
    out = df.withColumn("line", files.chapter_text(F.col("a"), F.col("b"), F.col("t")))
    files.write_lines(out, str(tmp_path / "c"), "line", "game_id", ["a"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "c" / "game_id=g").glob("part*")))
    assert text.count("[CHAPTER]") == 2 and "START=10000\nEND=17500\ntitle=c\\;d" in text and "gone" not in text
    assert spark.range(1).select(parse.time_label(F.lit(3725.9))).first()[0] == "1:02:05"


def test_probe(spark):
    doc = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "width": 1280, "height": 720, "avg_frame_rate": "59939/1000", "r_frame_rate": "60000/1001"}], "format": {"duration": "12.5", "size": "99"}})
    r = files.media_probe(spark.createDataFrame([(1, doc), (2, "x")], "id int, raw string"), "raw").orderBy("id").collect()
    assert (r[0].fps_num, r[0].fps_den, r[0].duration, r[0].bytes, r[0].codec) == (60000, 1001, 12.5, 99, "h264") and r[1].codec is None
