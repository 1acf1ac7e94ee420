"""Queries of the league feeds, with their SQL: every document is JSON text made of the driver's tables and parsed again.

A user is a game and every event a row of its feed; a customer is a day's schedule and every order a game of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.q_sequence import EV, events
from tidemark.sources import feeds, files
from tidemark.sources.files import table

#: Running scores of a row; they fall back now and then.
HOME, AWAY = "floor(i / 2.0::DOUBLE + value / 50)::INT", "floor(i / 3.0::DOUBLE + value / 40)::INT"


def _fold(rows: str) -> str:
    """CTEs after ``ev``: ``s`` has the scoring rows of ``rows`` (user_id, i, h, a, ...) with side and points."""
    known, rose = "n.h IS NOT NULL AND n.a IS NOT NULL", "n.h > f.h OR n.a > f.a"
    state = lambda x: f"CASE WHEN NOT ({known}) THEN f.{x} WHEN {rose} THEN n.{x} ELSE greatest(n.{x}, f.{x}) END"
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS k FROM ({rows})),
      f AS (SELECT user_id, -1::BIGINT AS k, 0 AS h, 0 AS a, NULL::VARCHAR AS side, 0 AS points FROM (SELECT DISTINCT user_id FROM n)
        UNION ALL SELECT n.user_id, n.k, {state("h")}, {state("a")}, CASE WHEN NOT ({known}) THEN NULL WHEN n.h > f.h THEN 'home' WHEN n.a > f.a THEN 'away' END,
          CASE WHEN n.h > f.h THEN n.h - f.h ELSE n.a - f.a END FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1),
      s AS (SELECT n.*, f.side, f.points FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k WHERE f.side IS NOT NULL)"""


def _scored(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.withColumn("h", F.floor(F.col("i") / 2 + F.col("value") / 50).cast("int")).withColumn("a", F.floor(F.col("i") / 3 + F.col("value") / 40).cast("int"))


def _per(rows: DataFrame, key: str, order: str, row: Column) -> DataFrame:
    """One array ``rows`` of feed rows for each entity, in order."""
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, row.alias("r")))).alias("rows"))
    return per.withColumn("rows", F.transform("rows", lambda r: r["r"]))


def _parsed(per: DataFrame, key: str, doc: Column, schema: str) -> DataFrame:
    return per.select(key, F.from_json(F.to_json(doc), schema).alias("doc"))


def _every(n: int, value: Column, key: str = "event_id") -> Column:
    """``value``, absent in every ``n``-th row."""
    return F.when(F.col(key) % n != 0, value)


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def action_feed(spark, sf_dir):
    """Actions without a score in error rows, of a made-up type in one of four kinds."""
    left = F.format_string("PT%dM%d.00S", 11 - F.col("i") % 12, F.floor("value") % 60)
    row = F.struct(
        F.col("i").alias("actionNumber"), F.when(F.col("i") % 7 != 0, 1 + F.floor(F.col("i") / 12)).alias("period"), left.alias("clock"), F.when(F.col("event_id") % 2 == 0, "nyk").otherwise("sas").alias("teamTricode"),
        F.when(~_is("error"), F.col("h").cast("string")).alias("scoreHome"), F.when(_is("error"), "x").otherwise(F.col("a").cast("string")).alias("scoreAway"),
        F.when(_is("click"), "freeThrow").otherwise("2pt").alias("actionType"), _every(3, F.lit("A. One")).alias("playerNameI"), _every(2, F.lit("Two")).alias("playerName"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("description"),
    )
    per = _per(_scored(spark, sf_dir), "user_id", "i", row)
    return feeds.action_events(_parsed(per, "user_id", F.struct(F.struct(F.col("user_id").cast("string").alias("gameId"), F.col("rows").alias("actions")).alias("game")), feeds.ACTIONS))


def summary_feed(spark, sf_dir):
    """Purchases and clicks are scoring plays; a third of them names no team of the game."""
    team = lambda side, i, code: F.struct(F.lit(side).alias("homeAway"), F.struct(F.lit(i).alias("id"), F.lit(code).alias("abbreviation")).alias("team"))
    who = F.concat(F.lit("Ann Lee"), F.col("user_id").cast("string"), F.lit(" makes layup"))
    row = F.struct(
        _every(4, F.col("event_id").cast("string")).alias("id"), F.col("i").cast("string").alias("sequenceNumber"), F.when(~_is("error"), _is("purchase") | _is("click")).alias("scoringPlay"), F.col("h").alias("homeScore"), F.col("a").alias("awayScore"),
        F.struct((F.col("event_id") % 3).cast("string").alias("id")).alias("team"), F.struct(F.when(F.col("event_id") % 5 == 0, "Free Throw").alias("text")).alias("type"), F.when(_is("purchase"), who).otherwise(" dunk ").alias("text"),
        F.struct((F.col("i") % 4 + 1).alias("number")).alias("period"), F.struct(F.format_string("%d:%02d", F.col("i") % 12, F.floor("value") % 60).alias("displayValue")).alias("clock"),
    )
    header = F.struct(F.array(F.struct(F.array(team("home", "0", "NY"), team("away", "1", "SA")).alias("competitors"))).alias("competitions"))
    per = _per(_scored(spark, sf_dir), "user_id", "i", row)
    return feeds.summary_events(_parsed(per, "user_id", F.struct(F.col("user_id").cast("string").alias("id"), header.alias("header"), F.col("rows").alias("plays")), feeds.SUMMARY))


def season_feed(spark, sf_dir):
    return feeds.season_events(
        _scored(spark, sf_dir).select(
            F.col("user_id").cast("string").alias("game_id"), F.col("i").alias("play_id"), (F.col("i") % 4 + 1).cast("int").alias("qtr"), F.col("value").alias("quarter_seconds_remaining"), F.col("h").alias("total_home_score"), F.col("a").alias("total_away_score"),
            F.when(F.col("event_id") % 3 == 0, "").otherwise("Tee").alias("td_player_name"), _every(2, F.lit("Kay")).alias("kicker_player_name"), (F.col("event_id") % 7 == 0).cast("int").alias("safety"), (F.col("event_id") % 5 == 0).cast("int").alias("two_point_attempt"),
        )
    )


def goal_feed(spark, sf_dir):
    """Purchases are goals of the home side, all others of the away side, views shots of a shootout; every third has a score."""
    ev = events(spark, sf_dir).withColumn("game_id", F.col("user_id").cast("string"))
    given = lambda n: F.when(F.col("event_id") % 3 == 0, F.floor(F.col("i") / n).cast("int"))
    rows = ev.select(
        "game_id", F.col("i").alias("sort_order"), "event_id", (F.col("i") % 3 + 1).cast("int").alias("period"), F.when(_is("view"), "SO").otherwise("REG").alias("period_type"), F.col("value").alias("seconds_left"),
        F.when(_is("purchase"), "home").otherwise("away").alias("owner"), given(4).alias("home"), given(3).alias("away"), (F.col("event_id") % 5).alias("player_id"),
    )
    names = ev.filter("event_id % 5 < 4").select("game_id", (F.col("event_id") % 5).alias("player_id")).distinct()
    return feeds.goal_events(rows, names.withColumn("scorer", F.concat(F.lit("P"), F.col("player_id").cast("string"))))


def at_bat_feed(spark, sf_dir):
    row = F.struct(
        F.struct(
            F.when(_is("error"), "").otherwise(F.col("a").cast("string")).alias("awayScore"), F.col("h").cast("string").alias("homeScore"), F.concat(F.lit(" "), "event_type").alias("description"),
            _every(3, F.initcap("event_type")).alias("event"), F.when(_is("click"), "home_run").otherwise("single").alias("eventType"), _every(4, F.col("event_id") % 4).alias("rbi"),
        ).alias("result"),
        F.struct(_every(6, F.col("i") % 9 + 1).alias("inning"), F.when(F.col("event_id") % 2 == 0, "top").otherwise("bottom").alias("halfInning"), _every(5, F.col("i").cast("string")).alias("atBatIndex")).alias("about"),
        F.struct(F.struct(_every(7, F.lit("Bo Bat")).alias("fullName")).alias("batter")).alias("matchup"),
    )
    per = _per(_scored(spark, sf_dir), "user_id", "i", row)
    docs = _parsed(per, "user_id", F.struct(F.col("rows").alias("allPlays")), feeds.AT_BATS).select(F.col("user_id").cast("string").alias("game_id"), "doc")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    games = users.select(F.col("user_id").cast("string").alias("game_id"), F.concat(F.lit("H"), F.col("user_id").cast("string")).alias("home"), F.when(F.col("user_id") % 4 != 0, "AW").alias("away"))
    return feeds.at_bat_events(docs, games)


def sidecar_feed(spark, sf_dir):
    team = F.when(F.col("event_id") % 3 == 0, "HOM").when(F.col("event_id") % 3 == 1, "AWY").otherwise("?")
    row = F.struct(F.col("event_id").cast("string").alias("event_id"), team.alias("team"), F.col("h").alias("score_home"), F.col("a").alias("score_away"), F.struct(F.when(F.col("event_id") % 10 == 0, "away").alias("side")).alias("extra"))
    per = _per(_scored(spark, sf_dir), "user_id", "i", row)
    docs = _parsed(per, "user_id", F.struct(F.lit("AWY").alias("away"), F.lit("HOM").alias("home"), F.col("rows").alias("events")), feeds.SIDECAR)
    return feeds.sidecar_events(docs.withColumnRenamed("user_id", "path")).select(F.col("path").alias("user_id"), "at", "event_id", "team", "score_home", "score_away", "side")


def _orders(spark, sf_dir):
    key = F.col("o_orderkey")
    codes = F.array(*map(F.lit, ("ny", " SA", "Utah", "bos")))
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", key.cast("string").alias("id"), F.get(codes, (key % 4).cast("int")).alias("home"), F.get(codes, ((key + 1) % 4).cast("int")).alias("away"),
        (key % 150).cast("string").alias("home_score"), F.when(key % 5 == 0, "x").otherwise((key % 140).cast("string")).alias("away_score"),
    )


def schedule_feed(spark, sf_dir):
    side = lambda s: F.struct(F.lit(s).alias("homeAway"), F.col(f"{s}_score").alias("score"), F.struct(F.col(s).alias("abbreviation"), _every(3, F.upper(s), "o_orderkey").alias("displayName")).alias("team"))
    notes = F.array(F.struct(F.concat(F.lit("Round "), "o_orderstatus").alias("headline")), F.struct(F.lit("").alias("headline")), F.struct(_every(2, F.lit("Late"), "o_orderkey").alias("headline")))
    game = F.struct(F.col("id"), F.array(F.struct(F.struct(F.struct(_every(4, F.col("o_orderpriority"), "o_orderkey").alias("description")).alias("type")).alias("status"), notes.alias("notes"), F.array(side("away"), side("home")).alias("competitors"))).alias("competitions"))
    per = _per(_orders(spark, sf_dir), "o_custkey", "o_orderkey", game)
    return feeds.schedule_games(_parsed(per, "o_custkey", F.struct(F.col("rows").alias("events")), feeds.SCHEDULE))


def board_feed(spark, sf_dir):
    side = lambda s: F.struct(F.col(s).alias("teamTricode"), _every(3, F.lit("City"), "o_orderkey").alias("teamCity"), F.upper(s).alias("teamName"), F.col(f"{s}_score").alias("score"))
    game = F.struct(
        F.col("id").alias("gameId"), F.concat("o_orderpriority", F.lit(" ")).alias("gameStatusText"), F.col("o_orderstatus").alias("gameLabel"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("Sub").alias("gameSubLabel"),
        _every(5, F.lit("2-1"), "o_orderkey").alias("seriesText"), side("home").alias("homeTeam"), _every(7, side("away"), "o_orderkey").alias("awayTeam"),
    )
    per = _per(_orders(spark, sf_dir), "o_custkey", "o_orderkey", game)
    return feeds.board_games(_parsed(per, "o_custkey", F.struct(F.struct(F.col("rows").alias("games")).alias("scoreboard")), feeds.BOARD))


def day_feed(spark, sf_dir):
    key = F.col("o_orderkey")
    side = lambda s: F.struct(F.col(f"{s}_score").alias("score"), F.struct(F.col(s).alias("abbreviation"), _every(3, F.upper(s), "o_orderkey").alias("name")).alias("team"))
    late = key % 6 == 0
    game = F.struct(
        F.col("id").alias("gamePk"), F.when(late, "W").otherwise("R").alias("gameType"), F.struct(F.lit("Live").alias("abstractGameState"), F.when(key % 4 == 0, "").otherwise("Final").alias("detailedState")).alias("status"),
        F.struct(side("home").alias("home"), side("away").alias("away")).alias("teams"), F.struct((key % 4 + 8).alias("currentInning"), F.when(key % 8 == 1, 0).otherwise(9).alias("scheduledInnings")).alias("linescore"),
        F.when(late, "World Series").otherwise("Regular Season").alias("seriesDescription"), (key % 7).alias("seriesGameNumber"), F.when(key % 3 == 0, "Y").otherwise("N").alias("doubleHeader"), (key % 2 + 1).alias("gameNumber"),
    )
    per = _per(_orders(spark, sf_dir), "o_custkey", "o_orderkey", game)
    return feeds.day_games(_parsed(per, "o_custkey", F.struct(F.array(F.struct(F.col("rows").alias("games"))).alias("dates")), feeds.DAYS))


def media_probe(spark, sf_dir):
    """Probe texts of every order: sound before video, every eleventh broken, every third at half its nominal rate."""
    key = F.col("o_orderkey")
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), (key % 1000).alias("width"), F.lit(720).alias("height"), F.when(key % 3 == 0, "30/1").otherwise("59939/1000").alias("avg_frame_rate"), F.lit("60000/1001").alias("r_frame_rate"))
    sound = F.struct(F.lit("audio").alias("codec_type"), *(F.lit(None).cast(t).alias(c) for c, t in (("codec_name", "string"), ("width", "bigint"), ("height", "int"), ("avg_frame_rate", "string"), ("r_frame_rate", "string"))))
    doc = F.struct(F.array(sound, video).alias("streams"), F.struct(F.concat((key % 90).cast("string"), F.lit(".5")).alias("duration"), key.cast("string").alias("size")).alias("format"))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 11 == 0, "{broken").otherwise(F.to_json(doc)).alias("raw"))
    return files.media_probe(raw, "raw").drop("raw")


PAIR = f"SELECT *, {HOME} AS h, {AWAY} AS a FROM ev"
CODE = lambda n, up: f"(CASE ({n}) % 4 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(("NYK", "SAS", "UTA", "BOS") if up else ("ny", " SA", "Utah", "bos"))) + " END)"
NAMED = lambda n: f"CASE WHEN o_orderkey % 3 <> 0 THEN upper({CODE(n, False)}) ELSE '' END"
SCORES = "(o_orderkey % 150)::INT AS home_score, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 140)::INT END AS away_score"
TEAM = lambda n: f"trim(CASE WHEN o_orderkey % 3 <> 0 THEN 'City' ELSE '' END || ' ' || upper({CODE(n, False)}))"
SQL = {
    "action_feed": f"""WITH RECURSIVE {EV}, {_fold(f"SELECT *, CASE WHEN event_type <> 'error' THEN {HOME} END AS h, CASE WHEN event_type <> 'error' THEN {AWAY} END AS a FROM ev")}
      SELECT user_id::VARCHAR AS game_id, i::VARCHAR AS event_id, (CASE WHEN i % 7 <> 0 THEN 1 + i // 12 ELSE 0 END)::INT AS period, ((11 - i % 12) * 60 + floor(value)::BIGINT % 60)::DOUBLE AS clock, CASE WHEN event_id % 2 = 0 THEN 'NYK' ELSE 'SAS' END AS team, side, points,
        CASE WHEN event_id % 3 <> 0 THEN 'A. One' WHEN event_id % 2 <> 0 THEN 'Two' ELSE '' END AS scorer, event_type AS description, a AS score_away, h AS score_home, CASE WHEN event_type = 'click' THEN 'free_throw' ELSE 'field_goal' END AS kind FROM s""",
    "summary_feed": f"""WITH RECURSIVE {EV}, {_fold(PAIR + " WHERE event_type IN ('purchase', 'click')")}
      SELECT user_id::VARCHAR AS game_id, CASE WHEN event_id % 4 <> 0 THEN event_id ELSE i END::VARCHAR AS event_id, (i % 4 + 1)::INT AS period, (i % 12 * 60 + floor(value)::BIGINT % 60)::DOUBLE AS clock,
        CASE WHEN event_id % 3 = 0 OR event_id % 3 = 2 AND side = 'home' THEN 'NYK' ELSE 'SAS' END AS team, side, points, CASE WHEN event_type = 'purchase' THEN 'A. Lee' || user_id ELSE '' END AS scorer,
        CASE WHEN event_type = 'purchase' THEN 'Ann Lee' || user_id || ' makes layup' ELSE 'dunk' END AS description, a AS score_away, h AS score_home, CASE WHEN event_id % 5 = 0 THEN 'free_throw' ELSE 'field_goal' END AS kind FROM s""",
    "season_feed": f"""WITH RECURSIVE {EV}, {_fold(PAIR)},
      b AS (SELECT *, CASE WHEN points >= 6 THEN 'touchdown' WHEN points = 3 THEN 'field_goal' WHEN points = 1 THEN 'extra_point' WHEN points = 2 THEN 'two' ELSE 'score' END AS basic FROM s),
      l AS (SELECT *, lag(basic) OVER (PARTITION BY user_id ORDER BY k) AS before FROM b),
      d AS (SELECT *, CASE WHEN basic <> 'two' THEN basic WHEN event_id % 7 = 0 THEN 'safety' WHEN before = 'touchdown' OR event_id % 5 = 0 THEN 'two_point' ELSE 'safety' END AS kind FROM l)
      SELECT user_id::VARCHAR AS game_id, i::VARCHAR AS event_id, (i % 4 + 1)::INT AS period, value AS clock, side, points, CASE WHEN kind = 'touchdown' AND event_id % 3 <> 0 THEN 'Tee' WHEN kind IN ('field_goal', 'extra_point') AND event_id % 2 <> 0 THEN 'Kay' ELSE '' END AS scorer,
        a AS score_away, h AS score_home, kind FROM d""",
    "goal_feed": f"""WITH RECURSIVE {EV},
      n AS (SELECT user_id, i, event_id, value, CASE WHEN event_type = 'purchase' THEN 'home' ELSE 'away' END AS owner, CASE WHEN event_id % 3 = 0 THEN (i // 4)::INT END AS h, CASE WHEN event_id % 3 = 0 THEN (i // 3)::INT END AS a,
        row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS k FROM ev WHERE event_type <> 'view'),
      f AS (SELECT user_id, -1::BIGINT AS k, 0 AS h, 0 AS a, 0 AS points FROM (SELECT DISTINCT user_id FROM n)
        UNION ALL SELECT user_id, k, CASE WHEN p > 0 THEN nh ELSE h END, CASE WHEN p > 0 THEN na ELSE a END, p FROM (SELECT *, CASE WHEN owner = 'home' THEN nh - h ELSE na - a END AS p
          FROM (SELECT n.user_id, n.k, n.owner, f.h, f.a, coalesce(n.h, f.h + (n.owner = 'home')::INT) AS nh, coalesce(n.a, f.a + (n.owner = 'away')::INT) AS na FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)))
      SELECT user_id::VARCHAR AS game_id, event_id % 5 AS player_id, event_id, (i % 3 + 1)::INT AS period, value AS clock, owner AS side, f.points, f.h AS score_home, f.a AS score_away, CASE WHEN event_id % 5 < 4 THEN 'P' || event_id % 5 END AS scorer
      FROM n JOIN f USING (user_id, k) WHERE f.points > 0""",
    "at_bat_feed": f"""WITH RECURSIVE {EV}, {_fold(f"SELECT *, {HOME} AS h, CASE WHEN event_type <> 'error' THEN {AWAY} END AS a FROM ev")},
      d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS step, CASE WHEN event_id % 6 <> 0 THEN i % 9 + 1 ELSE 0 END::INT AS inning, CASE WHEN event_id % 2 = 0 THEN 'top' ELSE 'bottom' END AS half FROM s)
      SELECT user_id::VARCHAR AS game_id, CASE WHEN event_id % 5 <> 0 THEN i ELSE step END::VARCHAR AS event_id, CASE WHEN inning = 0 THEN 0 ELSE 2 * inning - (half = 'top')::INT END AS period, NULL::DOUBLE AS clock,
        CASE WHEN side = 'home' THEN 'H' || user_id WHEN user_id % 4 <> 0 THEN 'AW' ELSE '' END AS team, side, points, CASE WHEN event_id % 7 <> 0 THEN 'Bo Bat' ELSE '' END AS scorer, event_type AS description, a AS score_away, h AS score_home,
        CASE WHEN event_type = 'click' THEN 'home_run' ELSE 'run' END AS kind, inning, half, CASE WHEN event_id % 3 <> 0 THEN upper(event_type[1]) || event_type[2:] ELSE '' END AS event, (event_id % 4)::INT AS rbi FROM d""",
    "sidecar_feed": f"""WITH {EV}, p AS ({PAIR}), l AS (SELECT *, coalesce(lag(h) OVER w, 0) AS h0, coalesce(lag(a) OVER w, 0) AS a0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i))
      SELECT user_id, i::INT AS at, event_id::VARCHAR AS event_id, CASE event_id % 3 WHEN 0 THEN 'HOM' WHEN 1 THEN 'AWY' ELSE '?' END AS team, h AS score_home, a AS score_away,
        CASE WHEN event_id % 10 = 0 THEN 'away' WHEN event_id % 3 = 0 THEN 'home' WHEN event_id % 3 = 1 THEN 'away' WHEN h > h0 THEN 'home' WHEN a > a0 THEN 'away' END AS side FROM l""",
    "schedule_feed": f"""SELECT o_orderkey::VARCHAR AS game_id, {CODE("o_orderkey", True)} AS home, {CODE("o_orderkey + 1", True)} AS away, {NAMED("o_orderkey")} AS home_name, {NAMED("o_orderkey + 1")} AS away_name, {SCORES},
      CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE '' END AS status, 'Round ' || o_orderstatus || CASE WHEN o_orderkey % 2 <> 0 THEN ' · Late' ELSE '' END AS label FROM orders""",
    "board_feed": f"""SELECT o_orderkey::VARCHAR AS game_id, {CODE("o_orderkey", False)} AS home, CASE WHEN o_orderkey % 7 <> 0 THEN {CODE("o_orderkey + 1", False)} ELSE '' END AS away, {TEAM("o_orderkey")} AS home_name,
      CASE WHEN o_orderkey % 7 <> 0 THEN {TEAM("o_orderkey + 1")} ELSE '' END AS away_name, (o_orderkey % 150)::INT AS home_score, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN (o_orderkey % 140)::INT END AS away_score, trim(o_orderpriority) AS status,
      o_orderstatus || CASE WHEN o_orderkey % 2 <> 0 THEN ' · Sub' ELSE '' END || CASE WHEN o_orderkey % 5 <> 0 THEN ' · 2-1' ELSE '' END AS label FROM orders""",
    "day_feed": f"""SELECT o_orderkey::VARCHAR AS game_id, {CODE("o_orderkey", False)} AS home, {NAMED("o_orderkey")} AS home_name, {CODE("o_orderkey + 1", False)} AS away, {NAMED("o_orderkey + 1")} AS away_name, {SCORES},
      CASE WHEN o_orderkey % 4 = 0 THEN 'Live' WHEN o_orderkey % 4 <> 1 THEN 'Final/' || (o_orderkey % 4 + 8) ELSE 'Final' END AS status,
      concat_ws(' · ', CASE WHEN o_orderkey % 6 = 0 THEN 'World Series' END, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 7 > 0 THEN 'Game ' || o_orderkey % 7 END, CASE WHEN o_orderkey % 3 = 0 THEN 'Doubleheader game ' || (o_orderkey % 2 + 1) END) AS label FROM orders""",
    "media_probe": """WITH p AS (SELECT *, o_orderkey % 11 <> 0 AS ok, o_orderkey % 3 = 0 AS half FROM orders)
      SELECT o_orderkey, CASE WHEN ok THEN 'h264' END AS codec, CASE WHEN ok THEN (o_orderkey % 1000)::INT END AS width, CASE WHEN ok THEN 720 END AS height, CASE WHEN ok THEN CASE WHEN half THEN 30 ELSE 60000 END END::BIGINT AS fps_num,
        CASE WHEN ok THEN CASE WHEN half THEN 1 ELSE 1001 END END::BIGINT AS fps_den, CASE WHEN ok THEN o_orderkey % 90 + 0.5 END::DOUBLE AS duration, CASE WHEN ok THEN o_orderkey END AS bytes FROM p""",
}
QUERIES = {f.__name__: f for f in (action_feed, summary_feed, season_feed, goal_feed, at_bat_feed, sidecar_feed, schedule_feed, board_feed, day_feed, media_probe)}
