"""Queries of interval algebra, with their SQL: six hours from each event, one hour after each error."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.plans.q_sequence import EV, KEY, events
from tidemark.sources.files import table

HOUR = 3600.0
SPANS = f"{EV}, spans AS (SELECT user_id, t AS a, t + {6 * HOUR} AS b FROM ev WHERE event_type <> 'error'), holes AS (SELECT user_id, t AS a, t + {2 * HOUR} AS b FROM ev WHERE event_type = 'error')"


def merged_sql(src: str, gap: float = 0.0) -> str:
    return f"""SELECT user_id, min(a) AS a, max(b) AS b FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b) AS island FROM (
        SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS new FROM {src})) GROUP BY user_id, island"""


def _spans(spark, sf_dir):
    ev = events(spark, sf_dir)
    of = lambda rows, hours: rows.select("user_id", F.col("t").alias("a"), (F.col("t") + hours * HOUR).alias("b"))
    return of(ev.filter("event_type <> 'error'"), 6), of(ev.filter("event_type = 'error'"), 2)


def interval_merge(spark, sf_dir):
    return intervals.merge(_spans(spark, sf_dir)[0], KEY, 600.0)


def interval_subtract(spark, sf_dir):
    spans, holes = _spans(spark, sf_dir)
    return intervals.subtract(intervals.merge(spans, KEY), holes, KEY)


def interval_clamp_total(spark, sf_dir):
    cut = intervals.clamp(intervals.merge(_spans(spark, sf_dir)[0], KEY), F.lit(1704067200.0 + 864000), F.lit(1704067200.0 + 30 * 86400))
    return intervals.total(cut, KEY).select("user_id", F.round("total", 3).alias("total"))


def interval_min_length(spark, sf_dir):
    spans, holes = _spans(spark, sf_dir)
    return intervals.long_enough(intervals.subtract(intervals.merge(spans, KEY), holes, KEY), HOUR)


def point_in_interval(spark, sf_dir):
    _, holes = _spans(spark, sf_dir)
    return intervals.containing(events(spark, sf_dir).filter("event_type <> 'error'"), holes, KEY, "t").select("event_id", "t")


def overlap_leak(spark, sf_dir):
    spans, holes = _spans(spark, sf_dir)
    return intervals.overlaps(spans, holes, KEY).select("user_id", "a", "b", F.col("_a").alias("hole_a"), F.round("shared", 3).alias("shared"))


def frame_snap(spark, sf_dir):
    spans = events(spark, sf_dir).select("user_id", (F.col("i") * 1.37).alias("a"), (F.col("i") * 1.37 + F.col("value") / 100).alias("b"))
    return intervals.snapped(spans, KEY, 30, 1)


def place_in_cut(spark, sf_dir):
    spans, _ = _spans(spark, sf_dir)
    out = intervals.place_in_cut(intervals.merge(spans, KEY), KEY, ["a"])
    return out.select("user_id", "a", F.round("out_start", 3).alias("out_start"), F.round("out_end", 3).alias("out_end"))


def edge_move(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.struct(F.lit(1.0).alias("a"), F.lit(2.0).alias("b")), F.struct(F.lit(5.0).alias("a"), F.lit(8.0).alias("b"))).alias("segments"), (F.pmod("o_orderkey", F.lit(7)) - 3).cast("double").alias("d"))
    moved = intervals.moved_edges(F.col("segments"), F.col("d"), F.col("d"), 0.2, F.lit(9.0))
    return o.withColumn("m", moved).select("o_orderkey", F.round(F.col("m")[0]["a"], 3).alias("first_in"), F.round(F.col("m")[1]["b"], 3).alias("last_out"))


def edge_trim(spark, sf_dir):
    flags = F.sort_array(F.collect_list(F.struct("i", (F.col("event_type") == "error").alias("x"))))
    per = events(spark, sf_dir).groupBy("user_id").agg(F.transform(flags, lambda s: s["x"]).alias("flags"))
    front, back = intervals.edge_trims(F.col("flags"), 2.0, F.size("flags") / 2.0, F.lit(5.0))
    return per.select("user_id", front.alias("front"), back.alias("back"))


def merge_fold(spark, sf_dir):
    ev = events(spark, sf_dir).filter(F.col("event_type").isin("click", "purchase"))
    return intervals.fold_clips(ev.select("user_id", F.col("t").alias("a"), (F.col("t") + 6 * HOUR).alias("b"), F.col("event_type").alias("team")), KEY)


PIECES = f"""m AS ({merged_sql('spans')}), h AS ({merged_sql('holes')}),
  c AS (SELECT m.user_id, m.a, m.b, h.a AS h0, h.b AS h1 FROM m LEFT JOIN h ON m.user_id = h.user_id AND h.b > m.a AND h.a < m.b),
  cuts AS (SELECT user_id, a, b, h0, h1, lag(h1) OVER (PARTITION BY user_id, a ORDER BY h0) AS before, lead(h0) OVER (PARTITION BY user_id, a ORDER BY h0) AS later FROM c),
  pieces AS (
    SELECT user_id, coalesce(before, a) AS a, coalesce(h0, b) AS b FROM cuts
    UNION ALL SELECT user_id, h1, b FROM cuts WHERE h1 IS NOT NULL AND later IS NULL)"""

SQL = {
    "merge_fold": f"""WITH RECURSIVE {EV}, c AS (SELECT user_id, t AS a, t + {6 * HOUR} AS b, event_type AS team, row_number() OVER (PARTITION BY user_id ORDER BY t, t + {6 * HOUR}, event_type) AS k FROM ev WHERE event_type IN ('click', 'purchase')),
      f AS (
        SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS clip, -1e18::DOUBLE AS e, ''::VARCHAR AS last, NULL::DOUBLE AS a, NULL::DOUBLE AS b, false AS kept FROM (SELECT DISTINCT user_id FROM c)
        UNION ALL
        SELECT user_id, k, CASE WHEN kept AND NOT joins THEN clip + 1 ELSE clip END, CASE WHEN joins THEN greatest(e, b) WHEN kept THEN b ELSE e END, CASE WHEN kept THEN team ELSE last END, a, b, kept FROM (
          SELECT c.user_id, c.k, f.clip, f.e, f.last, c.team, c.b, c.a <= f.e AND c.team = f.last AS joins, CASE WHEN c.a <= f.e AND c.team <> f.last THEN f.e ELSE c.a END AS a,
            NOT (c.a <= f.e AND c.team <> f.last) OR c.b - f.e >= 0.4 AS kept FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k + 1))
      SELECT user_id, min(a) AS a, max(b) AS b, min(last) AS team, count(*) AS n FROM f WHERE kept GROUP BY user_id, clip""",
    "interval_merge": f"WITH {SPANS} {merged_sql('spans', 600.0)}",
    "interval_subtract": f"WITH {SPANS}, {PIECES} SELECT * FROM pieces WHERE b > a",
    "interval_clamp_total": f"""WITH {SPANS}, m AS ({merged_sql('spans')}), k AS (SELECT user_id, greatest(a, 1704931200.0) AS a, least(b, 1706659200.0) AS b FROM m)
      SELECT user_id, round(sum(b - a), 3) AS total FROM k WHERE b > a GROUP BY user_id""",
    "interval_min_length": f"WITH {SPANS}, {PIECES} SELECT user_id, round(a, 3) AS a, round(b, 3) AS b FROM pieces WHERE b - a >= {HOUR}",
    "point_in_interval": f"WITH {SPANS} SELECT event_id, t FROM ev e WHERE event_type <> 'error' AND EXISTS (SELECT 1 FROM holes h WHERE h.user_id = e.user_id AND e.t >= h.a AND e.t < h.b)",
    "overlap_leak": f"WITH {SPANS} SELECT s.user_id, s.a, s.b, h.a AS hole_a, round(least(s.b, h.b) - greatest(s.a, h.a), 3) AS shared FROM spans s JOIN holes h ON s.user_id = h.user_id AND s.a < h.b AND h.a < s.b WHERE least(s.b, h.b) - greatest(s.a, h.a) > 0.001",
    "frame_snap": f"""WITH {EV}, f AS (SELECT user_id, floor(i * 1.37::DOUBLE * 30 + 0.5)::BIGINT AS a, floor((i * 1.37::DOUBLE + value / 100) * 30 + 0.5)::BIGINT AS b FROM ev)
      SELECT user_id, a AS first_frame, b - a AS frames FROM ({merged_sql('f', 1)}) WHERE b - a >= 2""",
    "place_in_cut": f"""WITH {SPANS}, m AS ({merged_sql('spans')}), p AS (SELECT *, sum(b - a) OVER (PARTITION BY user_id ORDER BY a) AS e FROM m)
      SELECT user_id, a, round(e - (b - a), 3) AS out_start, round(e, 3) AS out_end FROM p""",
    "edge_move": """WITH d AS (SELECT o_orderkey, (o_orderkey % 7 - 3)::DOUBLE AS d FROM orders)
      SELECT o_orderkey, round(greatest(0, least(1 + d, 1.8)), 3) AS first_in, round(least(9, greatest(8 + d, 5.2)), 3) AS last_out FROM d""",
    "edge_trim": f"""WITH {EV}, g AS (SELECT user_id, string_agg(CASE WHEN event_type = 'error' THEN 'x' ELSE '.' END, '' ORDER BY i) AS s, count(*) AS n FROM ev GROUP BY user_id),
      p AS (SELECT *, n - length(regexp_extract(s, '(x*)$', 1)) AS good, length(regexp_extract(s, '^(\\.*)x', 1)) AS f, length(regexp_extract(s, '^\\.*(x+)', 1)) AS r, n / 2.0::DOUBLE AS dur FROM g),
      q AS (SELECT *, CASE WHEN good > 0 AND good < n AND dur - ((good - 1) / 2.0::DOUBLE + 0.1::DOUBLE) BETWEEN 1e-300 AND 2.0 THEN dur - ((good - 1) / 2.0::DOUBLE + 0.1::DOUBLE) ELSE 0 END AS back,
        CASE WHEN r >= 2 AND f / 2.0 <= 2.5 AND f + r < n AND (f + r) / 2.0 <= 12 THEN (f + r) / 2.0::DOUBLE ELSE 0 END AS front FROM p)
      SELECT user_id, round(CASE WHEN dur - front - back < 5 THEN 0 ELSE front END, 3)::DOUBLE AS front, round(CASE WHEN dur - front - back < 5 AND dur - back < 5 THEN 0 ELSE back END, 3)::DOUBLE AS back FROM q""",
}

QUERIES = {f.__name__: f for f in (interval_merge, interval_subtract, interval_clamp_total, interval_min_length, point_in_interval, overlap_leak, frame_snap, place_in_cut, edge_move, edge_trim, merge_fold)}
