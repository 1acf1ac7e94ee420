"""League feeds (nested JSON) as one table of scoring events, and game schedules as rows.

Feeds are read with explicit schemas in PERMISSIVE mode; a field that is absent is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import parse

ACTIONS = "struct<game:struct<gameId:string,actions:array<struct<actionNumber:bigint,period:int,clock:string,teamTricode:string,scoreHome:string,scoreAway:string,actionType:string,subType:string,playerNameI:string,playerName:string,description:string>>>>"
SUMMARY = "struct<id:string,header:struct<competitions:array<struct<competitors:array<struct<homeAway:string,team:struct<id:string,abbreviation:string>>>>>>,plays:array<struct<id:string,sequenceNumber:string,scoringPlay:boolean,homeScore:int,awayScore:int,team:struct<id:string>,type:struct<text:string>,text:string,period:struct<number:int>,clock:struct<displayValue:string>>>>"
SIDECAR = "struct<away:string,home:string,events:array<struct<event_id:string,period:int,clock:double,team:string,points:int,scorer:string,description:string,score_away:int,score_home:int,kind:string,extra:map<string,string>>>>"
SCHEDULE = "struct<events:array<struct<id:string,competitions:array<struct<status:struct<type:struct<description:string>>,notes:array<struct<headline:string>>,competitors:array<struct<homeAway:string,score:string,team:struct<abbreviation:string,displayName:string>>>>>>>>"
BOARD = "struct<scoreboard:struct<games:array<struct<gameId:string,gameStatusText:string,gameLabel:string,gameSubLabel:string,seriesText:string,homeTeam:struct<teamTricode:string,teamCity:string,teamName:string,score:string>,awayTeam:struct<teamTricode:string,teamCity:string,teamName:string,score:string>>>>>"
DAYS = "struct<dates:array<struct<games:array<struct<gamePk:string,gameType:string,status:struct<abstractGameState:string,detailedState:string>,teams:struct<home:struct<score:string,team:struct<abbreviation:string,name:string>>,away:struct<score:string,team:struct<abbreviation:string,name:string>>>,linescore:struct<currentInning:int,scheduledInnings:int>,seriesDescription:string,seriesGameNumber:int,doubleHeader:string,gameNumber:int>>>>>"
AT_BATS = "struct<allPlays:array<struct<result:struct<awayScore:string,homeScore:string,description:string,event:string,eventType:string,rbi:int>,about:struct<inning:int,halfInning:string,atBatIndex:string>,matchup:struct<batter:struct<fullName:string>>>>>"
#: Game types played after the regular season (fixed values).
LATE_TYPES = ("F", "D", "L", "W")
#: Codes that one feed spells differently (fixed values).
OTHER_CODES = {"GS": "GSW", "NO": "NOP", "NY": "NYK", "SA": "SAS", "UTAH": "UTA", "WSH": "WAS"}

#: Codes of clubs that have moved (fixed values).
MOVED_CODES = {"OAK": "LV", "SD": "LAC", "STL": "LA", "LAR": "LA", "JAC": "JAX", "WSH": "WAS"}
#: Columns that may name the scorer of a kind, in order (fixed values).
SCORERS = {
    "touchdown": ("td_player_name",),
    "field_goal": ("kicker_player_name",),
    "extra_point": ("kicker_player_name",),
    "two_point": ("receiver_player_name", "rusher_player_name", "passer_player_name"),
    "safety": ("safety_player_name",),
}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file, as column ``doc`` with its ``path``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc"))


def translated(code: Column, codes: dict[str, str] = OTHER_CODES) -> Column:
    up = F.upper(F.trim(code))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), up), up)


def score_fold(rows: Column) -> Column:
    """Scoring steps of an ordered array of (home, away, ...): array of (row, side, points, previous kind is up to the caller).

    The running state takes the larger of both scores while neither rises; else the row's own
    pair, whatever it is, and home counts first. The state depends on every row before, which is
    what ``aggregate`` over the entity's ordered rows expresses.
    """
    step_type = "struct<at:int,side:string,points:int,home:int,away:int>"
    start = F.struct(F.lit(0).alias("home"), F.lit(0).alias("away"), F.lit(0).alias("n"), F.array().cast(f"array<{step_type}>").alias("steps"))

    def step(s: Column, r: Column) -> Column:
        dh, da = r["home"] - s["home"], r["away"] - s["away"]
        rose = (dh > 0) | (da > 0)
        new = F.struct(s["n"].alias("at"), F.when(dh > 0, "home").otherwise("away").alias("side"), F.when(dh > 0, dh).otherwise(da).alias("points"), r["home"].alias("home"), r["away"].alias("away"))
        known = r["home"].isNotNull() & r["away"].isNotNull()
        return F.struct(
            F.when(known, F.when(rose, r["home"]).otherwise(F.greatest(s["home"], r["home"]))).otherwise(s["home"]).alias("home"),
            F.when(known, F.when(rose, r["away"]).otherwise(F.greatest(s["away"], r["away"]))).otherwise(s["away"]).alias("away"),
            (s["n"] + 1).alias("n"),
            F.when(known & rose, F.concat(s["steps"], F.array(new))).otherwise(s["steps"]).alias("steps"),
        )

    return F.aggregate(rows, start, step, lambda s: s["steps"])


def _steps(games: DataFrame, rows: str, home: Column, away: Column) -> DataFrame:
    """Games with exploded scoring steps, their number ``_k`` and the feed row ``r`` of each."""
    pairs = F.transform(rows, lambda r: F.struct(home(r).alias("home"), away(r).alias("away")))
    found = games.select("*", F.posexplode(score_fold(pairs)).alias("_k", "_s"))
    return found.withColumn("r", F.get(F.col(rows), F.col("_s.at")))


def action_events(docs: DataFrame) -> DataFrame:
    """Scoring events of an action list."""
    games = docs.select(F.col("doc.game.gameId").alias("game_id"), F.col("doc.game.actions").alias("rows")).filter("rows is not null")
    s = _steps(games, "rows", lambda r: r["scoreHome"].try_cast("int"), lambda r: r["scoreAway"].try_cast("int"))
    free = F.lower(F.coalesce("r.actionType", F.lit(""))).contains("free")
    return s.select(
        "game_id", F.col("r.actionNumber").cast("string").alias("event_id"), F.coalesce("r.period", F.lit(0)).alias("period"), parse.iso_clock(F.col("r.clock")).alias("clock"),
        F.upper(F.coalesce("r.teamTricode", F.lit(""))).alias("team"), F.col("_s.side").alias("side"), F.col("_s.points").alias("points"),
        F.coalesce("r.playerNameI", "r.playerName", F.lit("")).alias("scorer"), F.trim(F.coalesce("r.description", F.lit(""))).alias("description"),
        F.col("_s.away").alias("score_away"), F.col("_s.home").alias("score_home"), F.when(free, "free_throw").otherwise("field_goal").alias("kind"),
    )


def summary_events(docs: DataFrame) -> DataFrame:
    """Scoring events of a summary with plays; teams by id, else by side."""
    comp = F.get(F.col("doc.header.competitions"), 0)["competitors"]
    games = docs.select(F.col("doc.id").alias("game_id"), comp.alias("teams"), F.filter("doc.plays", lambda p: p["scoringPlay"]).alias("rows")).filter("rows is not null")
    s = _steps(games, "rows", lambda r: r["homeScore"], lambda r: r["awayScore"])
    by_id = F.get(F.filter("teams", lambda t: t["team"]["id"] == F.col("r.team.id")), 0)["team"]["abbreviation"]
    by_side = F.get(F.filter("teams", lambda t: t["homeAway"] == F.col("_s.side")), 0)["team"]["abbreviation"]
    text, kind = F.trim(F.coalesce("r.text", F.lit(""))), F.lower(F.coalesce("r.type.text", F.lit("")))
    free = kind.contains("free throw") | F.lower(text).contains("free throw")
    return s.select(
        "game_id", F.coalesce("r.id", "r.sequenceNumber").alias("event_id"), F.coalesce("r.period.number", F.lit(0)).alias("period"), parse.iso_clock(F.col("r.clock.displayValue")).alias("clock"),
        translated(F.coalesce(by_id, by_side)).alias("team"), F.col("_s.side").alias("side"), F.col("_s.points").alias("points"),
        F.when(text.contains(" makes "), parse.initial_name(F.element_at(F.split(text, " makes "), 1))).otherwise("").alias("scorer"), text.alias("description"),
        F.col("_s.away").alias("score_away"), F.col("_s.home").alias("score_home"), F.when(free, "free_throw").otherwise("field_goal").alias("kind"),
    )


def season_events(rows: DataFrame) -> DataFrame:
    """Scoring plays of a columnar season (game_id, play_id, qtr, quarter_seconds_remaining, totals, names): kinds by points and the play before."""
    ordered = rows.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("play_id", *[c for c in rows.columns if c not in ("game_id", "play_id")]))).alias("rows"))
    s = _steps(ordered, "rows", lambda r: r["total_home_score"].try_cast("int"), lambda r: r["total_away_score"].try_cast("int"))
    p = F.col("_s.points")
    basic = F.when(p >= 6, "touchdown").when(p == 3, "field_goal").when(p == 1, "extra_point").when(p == 2, "two")
    before = F.lag(F.col("_basic")).over(Window.partitionBy("game_id").orderBy("_s.at"))
    # a two after a touchdown is a try; what it is itself never makes a later two a try
    two = F.when(F.col("r.safety").try_cast("int") == 1, "safety").when((before == "touchdown") | (F.col("r.two_point_attempt").try_cast("int") == 1), "two_point").otherwise("safety")
    kind = F.when(F.col("_basic") == "two", two).otherwise(F.coalesce("_basic", F.lit("score")))
    empty = F.lit("")
    scorer = F.coalesce(*(F.when(F.col("kind") == k, F.coalesce(*(F.nullif(F.col(f"r.{c}"), empty) for c in names if c in rows.columns), empty)) for k, names in SCORERS.items()), empty)
    return s.withColumn("_basic", basic).withColumn("kind", kind).select(
        "game_id", F.col("r.play_id").cast("string").alias("event_id"), F.coalesce("r.qtr", F.lit(0)).alias("period"), F.col("r.quarter_seconds_remaining").cast("double").alias("clock"),
        F.col("_s.side").alias("side"), p.alias("points"), scorer.alias("scorer"),
        F.col("_s.away").alias("score_away"), F.col("_s.home").alias("score_home"), "kind",
    )


def at_bat_events(docs: DataFrame, games: DataFrame) -> DataFrame:
    """Scoring events of lists of times at bat: columns game_id and ``doc``; ``games`` has the codes of home and away.

    The period counts half innings, bottom after top, 0 where the inning is unknown; there is no clock.
    """
    plays = docs.select("game_id", F.col("doc.allPlays").alias("rows")).filter("rows is not null")
    s = _steps(plays, "rows", lambda r: r["result"]["homeScore"].try_cast("int"), lambda r: r["result"]["awayScore"].try_cast("int"))
    s = s.join(games.select("game_id", F.col("home").alias("_home"), F.col("away").alias("_away")), "game_id", "left")
    inning, empty = F.coalesce("r.about.inning", F.lit(0)), F.lit("")
    bottom = F.coalesce(F.col("r.about.halfInning") == "bottom", F.lit(False))
    return s.select(
        "game_id", F.coalesce("r.about.atBatIndex", F.col("_k").cast("string")).alias("event_id"), F.when(inning == 0, 0).otherwise(2 * inning - (~bottom).cast("int")).alias("period"),
        F.lit(None).cast("double").alias("clock"), F.coalesce(F.when(F.col("_s.side") == "home", F.col("_home")).otherwise(F.col("_away")), empty).alias("team"), F.col("_s.side").alias("side"),
        F.col("_s.points").alias("points"), F.coalesce("r.matchup.batter.fullName", empty).alias("scorer"), F.trim(F.coalesce("r.result.description", empty)).alias("description"),
        F.col("_s.away").alias("score_away"), F.col("_s.home").alias("score_home"), F.when(F.col("r.result.eventType") == "home_run", "home_run").otherwise("run").alias("kind"),
        inning.alias("inning"), F.when(bottom, "bottom").otherwise("top").alias("half"), F.coalesce("r.result.event", empty).alias("event"), F.coalesce("r.result.rbi", F.lit(0)).alias("rbi"),
    )


def goal_events(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Goals (no shootout) with running scores; a goal without a score adds one to its owner's.

    rows: game_id, sort_order, event_id, period, period_type, seconds_left, owner ('home', 'away'), home, away, player_id.
    """
    goals = rows.filter("period_type <> 'SO'")
    per = goals.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "event_id", "period", "seconds_left", "owner", "home", "away", "player_id"))).alias("rows"))

    def step(s: Column, r: Column) -> Column:
        home = F.coalesce(r["home"], s["home"] + (r["owner"] == "home").cast("int"))
        away = F.coalesce(r["away"], s["away"] + (r["owner"] == "away").cast("int"))
        points = F.when(r["owner"] == "home", home - s["home"]).otherwise(away - s["away"])
        new = F.struct(r["event_id"].alias("event_id"), r["period"].alias("period"), r["seconds_left"].alias("clock"), r["owner"].alias("side"), points.alias("points"), home.alias("score_home"), away.alias("score_away"), r["player_id"].alias("player_id"))
        ok = points > 0  # else the state stays
        return F.struct(F.when(ok, home).otherwise(s["home"]).alias("home"), F.when(ok, away).otherwise(s["away"]).alias("away"), F.when(ok, F.concat(s["out"], F.array(new))).otherwise(s["out"]).alias("out"))

    kind = "array<struct<event_id:bigint,period:int,clock:double,side:string,points:int,score_home:int,score_away:int,player_id:bigint>>"
    start = F.struct(F.lit(0).alias("home"), F.lit(0).alias("away"), F.array().cast(kind).alias("out"))
    found = per.select("game_id", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("e")).select("game_id", "e.*")
    return found.join(names, ["game_id", "player_id"], "left")


def defensive_plays(rows: DataFrame, text: str, kind: str) -> DataFrame:
    """Steals and blocks: typed rows, and untyped ones whose text names one."""
    up = F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), r"\b(STEAL|BLOCK)\b", 1)
    typed = F.lower(F.coalesce(kind, F.lit("")))
    found = F.when(typed.isin("steal", "block"), typed).when((typed == "") & (up != ""), F.lower(up))
    return rows.withColumn("defense", found).filter(F.col("defense").isNotNull())


def described_defense(text: Column) -> Column:
    """Struct of player and kind from a sentence of a shot or turnover; NULL kind where there is none."""
    t = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""), " ")
    inside, block = r"\(([^()]+?) (steals|blocks)\)", r"^(.+?) blocks "
    who = F.coalesce(F.nullif(F.regexp_extract(t, inside, 1), F.lit("")), F.nullif(F.regexp_extract(t, block, 1), F.lit("")))
    what = F.when(t.rlike(inside), F.when(F.regexp_extract(t, inside, 2) == "steals", "steal").otherwise("block")).when(t.rlike(block), "block")
    return F.struct(F.when(what.isNotNull(), parse.initial_name(F.trim(who))).alias("player"), what.alias("kind"))


def sidecar_events(docs: DataFrame) -> DataFrame:
    """Events of sidecar files; a missing side comes from the team, else from the score that rose."""
    e = docs.select("path", "doc.away", "doc.home", F.posexplode("doc.events").alias("at", "e"))
    w = Window.partitionBy("path").orderBy("at")
    home, away = F.col("e.score_home"), F.col("e.score_away")
    rose = F.when(home > F.coalesce(F.lag(home).over(w), F.lit(0)), "home").when(away > F.coalesce(F.lag(away).over(w), F.lit(0)), "away")
    by_team = F.when(F.col("e.team") == F.col("home"), "home").when(F.col("e.team") == F.col("away"), "away")
    return e.select("path", "at", "e.*", F.coalesce(F.try_element_at("e.extra", F.lit("side")), by_team, rose).alias("side"))


def _of_team(games: DataFrame, team: str | None) -> DataFrame:
    return games.filter((F.upper("home") == team.upper()) | (F.upper("away") == team.upper())) if team else games


def _joined(*parts: Column) -> Column:
    """Parts that say something, in order."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " · ")


def schedule_games(docs: DataFrame, team: str | None = None) -> DataFrame:
    """Games of a scoreboard document by competitions, of one team if named."""
    g = docs.select(F.explode("doc.events").alias("e")).withColumn("c", F.get(F.col("e.competitions"), 0))
    of = lambda side: F.get(F.filter("c.competitors", lambda x: x["homeAway"] == side), 0)
    empty, lines = F.lit(""), F.transform("c.notes", lambda n: n["headline"])
    out = g.select(
        F.col("e.id").alias("game_id"), translated(of("home")["team"]["abbreviation"]).alias("home"), translated(of("away")["team"]["abbreviation"]).alias("away"),
        F.coalesce(of("home")["team"]["displayName"], empty).alias("home_name"), F.coalesce(of("away")["team"]["displayName"], empty).alias("away_name"),
        of("home")["score"].try_cast("int").alias("home_score"), of("away")["score"].try_cast("int").alias("away_score"), F.coalesce("c.status.type.description", empty).alias("status"),
        F.coalesce(F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), " · "), empty).alias("label"),
    )
    return _of_team(out, team)


def board_games(docs: DataFrame, team: str | None = None) -> DataFrame:
    """Games of a scoreboard document by teams, of one team if named."""
    g = docs.select(F.explode("doc.scoreboard.games").alias("g")).select("g.*")
    empty = F.lit("")
    name = lambda t: F.trim(F.concat_ws(" ", F.coalesce(f"{t}.teamCity", empty), F.coalesce(f"{t}.teamName", empty)))
    out = g.select(
        F.col("gameId").alias("game_id"), F.coalesce("homeTeam.teamTricode", empty).alias("home"), F.coalesce("awayTeam.teamTricode", empty).alias("away"), name("homeTeam").alias("home_name"), name("awayTeam").alias("away_name"),
        F.col("homeTeam.score").try_cast("int").alias("home_score"), F.col("awayTeam.score").try_cast("int").alias("away_score"), F.trim(F.coalesce("gameStatusText", empty)).alias("status"),
        _joined(F.col("gameLabel"), F.col("gameSubLabel"), F.col("seriesText")).alias("label"),
    )
    return _of_team(out, team)


def day_games(docs: DataFrame, team: str | None = None) -> DataFrame:
    """Games of a schedule by days, of one team if named; a final of unusual length says its innings."""
    g = docs.select(F.explode("doc.dates").alias("d")).select(F.explode("d.games").alias("g")).select("g.*")
    empty = F.lit("")
    state = F.coalesce(F.nullif("status.detailedState", empty), "status.abstractGameState", empty)
    planned = F.coalesce(F.nullif("linescore.scheduledInnings", F.lit(0)), F.lit(9))
    odd = (state == "Final") & (F.col("linescore.currentInning") > 0) & (F.col("linescore.currentInning") != planned)
    series = F.when(F.col("seriesDescription") != "Regular Season", F.nullif("seriesDescription", empty))
    number = F.when(series.isNotNull() & F.col("gameType").isin(*LATE_TYPES) & (F.col("seriesGameNumber") > 0), F.concat(F.lit("Game "), "seriesGameNumber"))
    twice = F.when(F.col("doubleHeader").isin("Y", "S"), F.concat(F.lit("Doubleheader game "), "gameNumber"))
    side = lambda s: (F.coalesce(f"teams.{s}.team.abbreviation", empty).alias(s), F.coalesce(f"teams.{s}.team.name", empty).alias(f"{s}_name"), F.col(f"teams.{s}.score").try_cast("int").alias(f"{s}_score"))
    out = g.select(
        F.col("gamePk").alias("game_id"), *side("home"), *side("away"), F.when(odd, F.concat(F.lit("Final/"), "linescore.currentInning")).otherwise(state).alias("status"),
        _joined(series, number, twice).alias("label"),
    )
    return _of_team(out, team)
