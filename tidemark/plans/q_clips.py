"""Queries of the clip rules over ``events`` (an entity is a user), with their SQL.

Rows are half a second apart by their index; purchases and clicks stand for scores of the two
sides, views for resets, and runs of errors for breaks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clipping, sequence
from tidemark.plans.q_sequence import EV, KEY, events
from tidemark.sources.files import table

STEP = 0.5
CAUSES = ["home", "away", "view", "bug_returned"]

ROWS = f"""{EV}, r AS (SELECT user_id, event_id, event_type, i, i / 2.0::DOUBLE AS s, floor(value)::BIGINT AS n FROM ev)"""
BREAKS = """br AS (SELECT user_id, min(s) - 0.25 AS a, max(s) + 0.75 AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM r WHERE event_type = 'error') GROUP BY user_id, g)"""
CHANGES = """ch AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'home' ELSE 'away' END AS team, s AS t, coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY i), 0.0::DOUBLE) AS t_prev, n, i FROM r WHERE event_type IN ('purchase', 'click'))"""


def _rows(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_id", "event_type", "i", (F.col("i") / 2).alias("t"), F.floor("value").alias("n"))


def _breaks(rows):
    """Runs of errors, a quarter of a second wider in front and three behind."""
    w = sequence.over(KEY, ["i"])
    out = rows.filter("event_type = 'error'").withColumn("_g", F.col("i") - F.row_number().over(w))
    return out.groupBy("user_id", "_g").agg((F.min("t") - 0.25).alias("a"), (F.max("t") + 0.75).alias("b")).drop("_g")


def _changes(rows):
    own = rows.filter(F.col("event_type").isin("purchase", "click"))
    prev = F.coalesce(F.lag("t").over(sequence.over(KEY, ["i"])), F.lit(0.0))
    return own.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "home").otherwise("away").alias("team"), "t", prev.alias("t_prev"), "n", "i")


def reset_valid(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("event_type <> 'error'").select("user_id", "event_id", "i", "t", (F.col("n") % 4 + 22).cast("double").alias("v"))
    return clipping.resets(rows, KEY, "v", "t", "i", (24.0, 23.0), 6).select("event_id", "reset_to", "reset_at")


def gap_before(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return clipping.gap_before(_changes(rows), _breaks(rows), KEY, STEP).select("event_id", "gap_a", "gap_b")


def _made(rows):
    changes = _changes(rows).withColumn("anchored", F.col("n") % 5 == 0)
    views = rows.filter("event_type = 'view'").select("user_id", "t", (F.col("t") + F.col("n") % 8).alias("t_start"))
    stops = rows.filter("event_type = 'error'").select("user_id", "t")
    return clipping.make_times(changes, views, stops, KEY, 1.0, 2.0)


def make_times(spark, sf_dir):
    return _made(_rows(spark, sf_dir)).select("event_id", "made")


def possession_starts(spark, sf_dir):
    """Starts and causes, and the clip ends that the makes give."""
    rows = _rows(spark, sf_dir)
    changes = _made(rows).withColumn("limit", F.coalesce(F.col("made") - 0.75, F.col("t") - 2.5))
    scores = changes.select("user_id", F.col("t").alias("at"), (F.col("t") + 1.0).alias("start"), F.col("team").alias("cause"))
    views = rows.filter("event_type = 'view'").select("user_id", F.col("t").alias("at"), F.col("t").alias("start"), F.lit("view").alias("cause"))
    back = _breaks(rows).select("user_id", F.col("b").alias("at"), F.when(F.col("b") - F.col("a") >= 2.0, F.col("b") + 1.0).alias("start"), F.lit("bug_returned").alias("cause"))
    out = clipping.last_starts(changes, scores.unionByName(views).unionByName(back), KEY, CAUSES, 5.0)
    return out.select("event_id", "start", "cause", clipping.clip_end(F.col("t"), F.col("made"), 1.5).alias("clip_end"))


def _follow(spark, sf_dir):
    """Score changes of a user: kinds by the value, the clock falls every fourth row."""
    w = sequence.over(KEY, ["i"])
    c = _changes(_rows(spark, sf_dir)).withColumn("event_index", F.row_number().over(w) - 1)
    points = F.when(F.col("n") % 4 == 0, 6).when(F.col("n") % 4 == 1, 1).otherwise(2)
    kind = F.when(F.col("n") % 4 == 0, "touchdown").when(F.col("n") % 4 == 3, "free_throws").otherwise("field_goal")
    clock = (700 - F.floor(F.col("i") / 8)).cast("double")
    rows = c.select("user_id", "event_id", "event_index", "t", "team", kind.alias("kind"), points.alias("points"), F.lit(1).alias("period"), F.when(F.col("n") % 11 > 0, clock).alias("clock"), clock.alias("held_clock"), (F.col("n") % 3 == 0).alias("stopped"), (F.col("n") % 7).cast("double").alias("stopped_for"))
    return clipping.followed(rows, KEY)


def follow_ups(spark, sf_dir):
    return _follow(spark, sf_dir).select("event_id", "role", "clip")


def clip_totals(spark, sf_dir):
    """Totals of the clips of the home side, follow-ups included."""
    rows = clipping.chosen(_follow(spark, sf_dir), KEY, F.col("team") == "home", free_throws=False)
    scored = rows.withColumns({"before": F.col("event_index"), "after": F.col("event_index") + F.col("points"), "score_away": F.lit(0), "score_home": F.col("event_index") + F.col("points")})
    return clipping.totals(scored, KEY, "clip").select("user_id", "clip", "points", "n_changes", "clock", "score_before", "score_after")


def side_cascade(spark, sf_dir):
    """Sides of customers' wished teams: nations stand for codes."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    wish = F.when(k % 5 == 0, "Away").when(k % 5 == 1, "").otherwise(F.concat(F.lit("T"), (k % 4).cast("string")))
    code = lambda x: F.concat(F.lit("t"), x.cast("string"))
    side = clipping.side_of(wish, (code(k % 3), code(k % 7)), (code(k % 6), F.lit(None).cast("string")), (F.lit(None).cast("string"), F.lit(None).cast("string")))
    return c.select("c_custkey", side.alias("side"))


_FOLLOW = f"""WITH {ROWS}, {CHANGES},
  e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS event_index, CASE n % 4 WHEN 0 THEN 6 WHEN 1 THEN 1 ELSE 2 END AS points,
    CASE n % 4 WHEN 0 THEN 'touchdown' WHEN 3 THEN 'free_throws' ELSE 'field_goal' END AS kind, (700 - i // 8)::DOUBLE AS held, CASE WHEN n % 11 > 0 THEN (700 - i // 8)::DOUBLE END AS clock FROM ch),
  p AS (SELECT *, lag(team) OVER w AS pteam, lag(kind) OVER w AS pkind, lag(t) OVER w AS pt, lag(held) OVER w AS pheld, lag(clock) OVER w AS pclock FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_index)),
  f AS (SELECT *, CASE
      WHEN pteam IS NULL OR pteam <> team THEN NULL
      WHEN pkind = 'touchdown' AND points IN (1, 2) AND CASE WHEN clock IS NULL OR pclock IS NULL THEN t - pt <= 90 ELSE abs(pclock - clock) <= 1 END THEN 'tail'
      WHEN kind <> 'free_throws' OR t - pt > 75 THEN NULL
      WHEN pkind <> 'free_throws' AND (n % 3 = 0 OR n % 7 >= 3) AND abs(held - pheld) <= 1.05 THEN 'and_one'
      WHEN pkind = 'free_throws' AND abs(held - pheld) <= 0.05 THEN 'more' END AS role FROM p),
  g AS (SELECT *, max(CASE WHEN role IS NULL THEN event_index END) OVER (PARTITION BY user_id ORDER BY event_index) AS clip FROM f)"""

_MADE = f"""WITH {ROWS}, {BREAKS}, {CHANGES},
  v AS (SELECT user_id, s AS t, s + n % 8 AS t_start FROM r WHERE event_type = 'view'), st AS (SELECT user_id, s AS t FROM r WHERE event_type = 'error'),
  l AS (SELECT c.*, v.t AS vt, v.t_start FROM ch c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t >= v.t),
  m AS (SELECT l.*, st.t AS stop FROM l ASOF LEFT JOIN st ON l.user_id = st.user_id AND l.t >= st.t),
  made AS (SELECT *, CASE
    WHEN n % 5 = 0 THEN CASE WHEN t - vt <= 1 AND t_start >= t - 0.5 THEN vt END
    WHEN t - vt <= 1 OR (t_start >= t - 1 AND t - vt <= 2) THEN vt WHEN t - stop <= 1 THEN stop END AS made FROM m)"""

SQL = {
    "reset_valid": f"""WITH {ROWS}, k AS (SELECT *, (n % 4 + 22)::DOUBLE AS v FROM r WHERE event_type <> 'error'),
      x AS (SELECT *, lag(v) OVER w AS was, lead(v) OVER w AS v1, lead(s) OVER w AS s1, lead(i) OVER w AS i1, lead(v, 2) OVER w AS v2, lead(s, 2) OVER w AS s2, lead(i, 2) OVER w AS i2 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY i)),
      y AS (SELECT *, i1 IS NOT NULL AND i1 - i <= 6 AS has1, coalesce(i1 - i <= 6 AND v1 <= v AND v1 >= v - (s1 - s) - 1, false) AS c1, coalesce(i2 - i <= 6 AND v2 <= v AND v2 >= v - (s2 - s) - 1, false) AS c2 FROM x WHERE v >= was + 1),
      z AS (SELECT *, CASE WHEN v IN (23, 24) AND (NOT has1 OR c1) THEN 'plain' WHEN v IN (23, 24) AND has1 AND v1 > was AND v1 < v AND v1 IN (23, 24) AND s1 - s <= 1.5 THEN 'lower' WHEN v = 22 AND v >= was + 2 AND c1 AND c2 AND v2 <= v1 THEN 'passed' END AS how FROM y)
      SELECT event_id, CASE how WHEN 'plain' THEN v WHEN 'lower' THEN v1 ELSE v + 1 END AS reset_to, CASE how WHEN 'lower' THEN s1 ELSE s END AS reset_at FROM z WHERE how IS NOT NULL""",
    "gap_before": f"""WITH {ROWS}, {BREAKS}, {CHANGES}
      SELECT c.event_id, min(b.a) AS gap_a, min(b.b) AS gap_b FROM ch c LEFT JOIN br b ON b.user_id = c.user_id AND b.a >= c.t_prev - 0.5 AND b.b <= c.t + 0.5 AND b.b - b.a >= 1 GROUP BY c.event_id""",
    "make_times": f"{_MADE} SELECT event_id, made FROM made",
    "possession_starts": f"""{_MADE}, q AS (SELECT *, coalesce(made - 0.75, t - 2.5) AS lim FROM made),
      signs AS (SELECT user_id, t AS at, t + 1 AS start, team AS cause FROM ch UNION ALL SELECT user_id, t, t, 'view' FROM v UNION ALL SELECT user_id, b, CASE WHEN b - a >= 2 THEN b + 1 END, 'bug_returned' FROM br),
      last AS (SELECT q.event_id, q.team, q.t, s.cause, max(struct_pack(at := s.at, start := s.start)) AS x FROM q JOIN signs s ON s.user_id = q.user_id AND s.at <= q.lim GROUP BY ALL),
      best AS (SELECT event_id, max(struct_pack(start := x.start, cause := CASE WHEN cause IN ('home', 'away') THEN CASE WHEN cause = team THEN 'own_score' ELSE 'opponent_score' END ELSE cause END)) AS y FROM last WHERE x.start IS NOT NULL GROUP BY event_id)
      SELECT q.event_id, CASE WHEN q.t - y.start <= 15 THEN y.start ELSE q.t - 5 END AS start, CASE WHEN q.t - y.start <= 15 THEN y.cause ELSE 'max_length' END AS cause,
        CASE WHEN made IS NULL THEN t + 1.5 ELSE least(t + 1.5, greatest(t + 0.5, made + 2.5)) END AS clip_end FROM q LEFT JOIN best USING (event_id)""",
    "follow_ups": f"{_FOLLOW} SELECT event_id, role, clip FROM g",
    "clip_totals": f"""{_FOLLOW}, h AS (SELECT g.*, d.kind AS hkind FROM g JOIN g d ON d.user_id = g.user_id AND d.event_index = g.clip WHERE g.team = 'home'),
      k AS (SELECT * FROM h WHERE role = 'tail' OR NOT (kind = 'free_throws' AND hkind = 'free_throws'))
      SELECT user_id, clip, sum(points)::BIGINT AS points, count(*) AS n_changes, first(clock ORDER BY event_index) AS clock, min(event_index) AS score_before, last(event_index + points ORDER BY event_index) AS score_after FROM k GROUP BY user_id, clip""",
    "side_cascade": """WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'AWAY' WHEN 1 THEN '' ELSE 'T' || (c_custkey % 4) END AS w, 'T' || (c_custkey % 3) AS pa, 'T' || (c_custkey % 7) AS ph, 'T' || (c_custkey % 6) AS ga FROM customer)
      SELECT c_custkey, CASE WHEN w = 'AWAY' THEN 'away' WHEN w = '' THEN 'home' WHEN w = pa THEN 'away' WHEN w = ph THEN 'home' WHEN w = ga THEN 'away' ELSE 'home' END AS side FROM c""",
}
QUERIES = {f.__name__: f for f in (reset_valid, gap_before, make_times, possession_starts, follow_ups, clip_totals, side_cascade)}
