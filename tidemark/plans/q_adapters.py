"""Queries of the rules by sport, on samples made of the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sequence
from tidemark.plans import adapters, clips, timeline
from tidemark.plans.q_sequence import EV, events

NAMES = ("basketball", "football", "hockey", "baseball")
PERIODS = ("1ST", "TOP 5", "▼5", "OT", "SO", "2OT", "MID 7", "4th", "3")
CLOCKS = (":42", "9:05", "0:59", "45.3", "19:59", ":7", "1022")


def _pick(names, by):
    return F.get(F.array(*map(F.lit, names)), (by % len(names)).cast("int"))


def _samples(spark, sf_dir):
    ev = events(spark, sf_dir)
    read = lambda text, by: F.struct(text.alias("text"), F.when(by % 11 == 0, 0.2).otherwise(0.9).cast("float").alias("conf"))
    e = F.col("event_id")
    fields = F.create_map(
        F.lit("period"), read(_pick(PERIODS, e), e), F.lit("clock"), read(_pick(CLOCKS, e + F.col("user_id")), e + 1), F.lit("shot_clock"), read((e % 45).cast("string"), e + 2),
        F.lit("home_score"), read((e % 300).cast("string"), e + 3), F.lit("away_score"), read(F.lit("x"), e), F.lit("count"), read(F.concat(F.lit(" "), (e % 4).cast("string"), F.lit("-"), (e % 3).cast("string")), e + 4),
    )
    return ev.select(_pick(NAMES, F.col("user_id")).alias("sport"), F.col("user_id").cast("string").alias("game_id"), F.col("i").cast("int").alias("i"), (F.col("i") / 2).alias("t"), (F.col("event_type") != "error").alias("visible"), fields.alias("fields"), "event_id")


def adapter_readings(spark, sf_dir):
    """Displays of four sports read in one pass."""
    rows = adapters.typed(_samples(spark, sf_dir))
    return rows.select("game_id", "sport", "i", "period", "clock", "shot_clock", "away_score", "home_score", F.col("texts")["count"].alias("count"), "game_seconds")


def adapter_starts(spark, sf_dir):
    """Purchases are scores, clicks starts of the clock, errors changes of the count."""
    ev = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("game_id"), _pick(NAMES, F.col("user_id")).alias("sport"), (F.col("i") / 2).alias("t"), "event_id", "event_type")
    signs = ev.filter("event_type IN ('click', 'error')").select("game_id", F.col("t").alias("at"), F.when(F.col("event_type") == "click", "clock").otherwise("count").alias("sign"))
    return adapters.play_starts(ev.filter("event_type = 'purchase'").drop("event_type"), signs).select("event_id", "sport", "start", "cause", "a", "b")


def _line(spark, sf_dir):
    """A timeline: the clock falls with clicks, the shot clock with clicks and purchases, errors hide both."""
    w = sequence.over(["user_id"], ["i"])
    clicks = F.sum((F.col("event_type") == "click").cast("int")).over(w)
    moves = F.sum(F.col("event_type").isin("click", "purchase").cast("int")).over(w)
    live = F.col("event_type") != "error"
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("game_id"), F.col("i").cast("int").alias("i"), (F.col("i") / 2).alias("t_video"), live.alias("live"),
        F.when(live, (80 - clicks).cast("double")).alias("clock"), F.when(live & (F.col("value") > 5), (24 - moves % 25).cast("double")).alias("shot_clock"),
    )


def clock_starts(spark, sf_dir):
    out = sequence.clock_starts(_line(spark, sf_dir), ["game_id"], ["i"], "clock", "shot_clock", "t_video", "live", 0.5, (24.0, 14.0))
    return out.select("game_id", F.round("at", 6).alias("at"), "stopped_for")


def shot_switched_off(spark, sf_dir):
    rows = _line(spark, sf_dir).withColumn("clock", F.when(F.col("live"), (F.col("i") % 60).cast("double"))).withColumn("shot_clock", F.when(F.col("i") % 9 < 4, F.col("shot_clock")))
    return clips.switched_off(rows, timeline.SPORTS["basketball"], 0.5)


PERIOD = {
    "quarter": (1, None, None, 5, None, 6, None, 4, 3), "overtime": (1, None, None, 4, 5, 5, None, None, 3), "inning": (1, 9, 10, None, None, None, 14, 7, 5),
}
CLOCK = {False: (None, 545.0, 59.0, 45.3, 1199.0, None, 622.0), True: (42.0, 545.0, 59.0, 45.3, 1199.0, None, 622.0)}


def _case(by: str, values) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values) if v is not None) + " END"


LINE = """l AS (SELECT user_id::VARCHAR AS game_id, i, i / 2 AS t, event_type <> 'error' AS live, CASE WHEN event_type <> 'error' THEN 80 - sum((event_type = 'click')::INT) OVER w END AS clock,
    CASE WHEN event_type <> 'error' AND value > 5 THEN 24 - sum((event_type IN ('click', 'purchase'))::INT) OVER w % 25 END AS shot FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i))"""


def readings_sql() -> str:
    by_sport = lambda f: "CASE s " + " ".join(f"WHEN {k} THEN {f(timeline.SPORTS[n])}" for k, n in enumerate(NAMES)) + " END"
    ok = lambda k: f"visible AND (event_id + {k}) % 11 <> 0"
    return f"""WITH {EV}, x AS (SELECT *, user_id % 4 AS s, event_type <> 'error' AS visible FROM ev),
  p AS (SELECT user_id::VARCHAR AS game_id, event_id, s, i, visible, CASE WHEN {ok(0)} THEN {by_sport(lambda x: _case('event_id % 9', PERIOD[x.reader]))} END AS period,
      CASE WHEN {ok(1)} THEN {by_sport(lambda x: _case('(event_id + user_id) % 7', CLOCK[x.colon_led]) if x.clocked else 'NULL')} END AS c,
      CASE WHEN {ok(2)} AND event_id % 45 <= 40 THEN (event_id % 45)::DOUBLE END AS h, CASE WHEN {ok(3)} AND event_id % 300 <= 250 THEN (event_id % 300)::INT END AS home_score,
      CASE WHEN {ok(4)} THEN (event_id % 4) || '-' || (event_id % 3) END AS "count",
      {by_sport(lambda x: x.regulation)} AS reg, {by_sport(lambda x: x.period_seconds)}::DOUBLE AS len, {by_sport(lambda x: x.overtime_seconds)}::DOUBLE AS ot, {by_sport(lambda x: x.shot_max)} AS most FROM x),
  q AS (SELECT *, CASE WHEN c <= len + 0.5 THEN c::DOUBLE END AS clock FROM p)
  SELECT game_id, (['basketball', 'football', 'hockey', 'baseball'])[s + 1] AS sport, i::INT AS i, period::INT AS period, clock, CASE WHEN h <= most + 0.5 THEN h END AS shot_clock, NULL::INT AS away_score, home_score, "count",
    CASE WHEN s = 3 THEN period::DOUBLE WHEN clock IS NOT NULL THEN least(period - 1, reg) * len + greatest(period - 1 - reg, 0) * ot + greatest(0, CASE WHEN period <= reg THEN len ELSE ot END - clock) END AS game_seconds FROM q"""


SQL = {
    "adapter_readings": readings_sql(),
    "adapter_starts": f"""WITH {EV}, e AS (SELECT event_id, user_id, user_id % 4 AS s, i / 2 AS t, event_type FROM ev), k AS (SELECT * FROM e WHERE event_type = 'click'), n AS (SELECT * FROM e WHERE event_type = 'error'),
  b AS (SELECT a.*, k.t AS ck FROM (SELECT * FROM e WHERE event_type = 'purchase') a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t > k.t),
  c AS (SELECT b.*, n.t AS ct FROM b ASOF LEFT JOIN n ON b.user_id = n.user_id AND b.t > n.t),
  r(s, sport, reach, back, cause, other, before, "after") AS (VALUES (0, 'basketball', NULL::DOUBLE, NULL::DOUBLE, NULL, NULL, 1.0, 1.5), (1, 'football', 20.0, 12.0, 'clock_start', '12s_before', 2.0, 2.0), (2, 'hockey', 15.0, 15.0, 'faceoff', '15s_before', 1.0, 2.0), (3, 'baseball', 40.0, 12.0, 'final_pitch', '12s_before', 3.0, 2.0)),
  d AS (SELECT event_id, t, sport, reach, back, r.cause AS yes, other, before, "after", CASE WHEN s = 3 THEN ct ELSE ck END AS l FROM c JOIN r USING (s))
  SELECT event_id, sport, CASE WHEN t - l <= reach THEN l ELSE t - back END AS start, CASE WHEN t - l <= reach THEN yes ELSE other END AS cause, CASE WHEN t - l <= reach THEN l ELSE t - back END - before AS a, t + "after" AS b FROM d""",
    "clock_starts": f"""WITH {EV}, {LINE}, k AS (SELECT *, lag(clock) OVER (PARTITION BY game_id ORDER BY i) AS pc FROM l WHERE live),
  r AS (SELECT *, sum((pc IS NULL OR abs(clock - pc) >= 0.05)::INT) OVER (PARTITION BY game_id ORDER BY i) AS run FROM k),
  g AS (SELECT game_id, run, min(t) AS a, max(t) AS b, max(i) AS li, any_value(clock) AS v FROM r GROUP BY 1, 2),
  n AS (SELECT *, lead(v) OVER w AS nv, lead(a) OVER w AS na, a - lag(b) OVER w AS gap FROM g WINDOW w AS (PARTITION BY game_id ORDER BY run)),
  h AS (SELECT n.*, o.shot FROM n JOIN l o ON o.game_id = n.game_id AND o.i = n.li WHERE b - a >= CASE WHEN gap IS NULL OR gap > 2 THEN 1.4 ELSE 2.4 END AND nv < v AND na - b <= 2.5),
  f AS (SELECT h.game_id, h.run, min(o.t) AS tick FROM h JOIN l o ON o.game_id = h.game_id AND o.i > h.li AND o.i <= h.li + 6 AND o.live AND o.shot < h.shot GROUP BY 1, 2),
  u AS (SELECT h.game_id, b, b - a AS stopped_for, least(na, coalesce(tick - CASE WHEN shot IN (24, 14) THEN 1 ELSE 0 END, na)) AS hi, greatest(na - 0.5 - CASE WHEN v < 60 THEN 0.1 ELSE 1 END, coalesce(tick - 1.5, -1e9)) AS lo FROM h LEFT JOIN f USING (game_id, run))
  SELECT game_id, round(greatest(CASE WHEN lo < hi THEN (lo + hi) / 2 ELSE hi - 0.5 END, b), 6)::DOUBLE AS at, stopped_for::DOUBLE AS stopped_for FROM u""",
    "shot_switched_off": f"""WITH {EV}, {LINE}, s AS (SELECT game_id, i, t, live, i % 60 AS clock, CASE WHEN i % 9 < 4 THEN shot END AS shot FROM l),
  w AS (SELECT *, lag(shot) OVER v AS prev, lag(live) OVER v AS plive, lead(i, 3) OVER v IS NOT NULL AS whole, count(shot) OVER (PARTITION BY game_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS known,
    min(live::INT) OVER (PARTITION BY game_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) AS alive FROM s WINDOW v AS (PARTITION BY game_id ORDER BY i))
  SELECT game_id, t - 0.25 AS t FROM w WHERE prev IS NOT NULL AND whole AND known = 0 AND alive = 1 AND clock <= 24.5""",
}
QUERIES = {f.__name__: f for f in (adapter_readings, adapter_starts, clock_starts, shot_switched_off)}
