"""Queries of the ordered-row operators over ``events`` (an entity is a user), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds, sequence, summaries
from tidemark.sources.files import micros, table

KEY, ORDER, DAY = ["user_id"], ["i"], 86400.0

EV = """ev AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1000000.0::DOUBLE AS t,
         CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with index, seconds, and the value unknown in error rows."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", (micros(F.col("ts")) / 1e6).alias("t"))
    return sequence.numbered(ev, KEY, ["ts", "event_id"]).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))


def ffill(spark, sf_dir):
    return sequence.forward_fill(events(spark, sf_dir), KEY, ORDER, "v", "filled").select("event_id", "filled")


def head_backfill(spark, sf_dir):
    return sequence.forward_fill(events(spark, sf_dir), KEY, ORDER, "v", "filled", head=True).select("event_id", "filled")


def interpolate_gaps(spark, sf_dir):
    out = sequence.interpolate(events(spark, sf_dir), KEY, ORDER, "t", "v", "line", DAY)
    return out.select("event_id", F.round("line", 6).alias("line"))


def nearest_known(spark, sf_dir):
    return sequence.nearest_known(events(spark, sf_dir), KEY, ORDER, "v", "near", 3).select("event_id", "near")


def islands_gap(spark, sf_dir):
    clicks = events(spark, sf_dir).filter(F.col("event_type").isin("click", "view", "purchase"))
    return sequence.gap_runs(clicks, KEY, "i", "t").select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


def state_runs(spark, sf_dir):
    return sequence.runs(events(spark, sf_dir), KEY, ORDER, "event_type").filter("value = 'error'").select("user_id", "t_first", "t_last")


def rle(spark, sf_dir):
    out = sequence.runs(events(spark, sf_dir), KEY, ORDER, "event_type")
    return out.select("user_id", "value", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


def not_live_widened(spark, sf_dir):
    return sequence.widened(events(spark, sf_dir), KEY, ORDER, F.col("event_type") != "error", "t", 0.5)


def hold_changes(spark, sf_dir):
    return sequence.held_changes(events(spark, sf_dir), KEY, ORDER, "event_type").select("user_id", "t", "old", "new")


def change_times(spark, sf_dir):
    top = events(spark, sf_dir).withColumn("top", F.max("v").over(sequence.over(KEY, ORDER)))
    return sequence.increases(top, KEY, ORDER, "top").select("event_id", "t", "before", F.col("top").alias("after"))


def running_flag(spark, sf_dir):
    return sequence.running(events(spark, sf_dir), KEY, ORDER, "v", "moves", 2, 0.05).filter("v IS NOT NULL").select("event_id", "moves")


def stopped_duration(spark, sf_dir):
    return sequence.held_for(events(spark, sf_dir), KEY, ORDER, "event_type", "t", "held", 2 * DAY).select("event_id", F.round("held", 3).alias("held"))


def range_max(spark, sf_dir):
    out = sequence.longest_hold_before(events(spark, sf_dir), KEY, "t", "value", "event_type", DAY, 60.0)
    return out.select("event_id", "longest", "held_value")


def clock_restarts(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("level", F.floor(F.col("value") / 50).cast("long"))
    return sequence.restarts(ev, KEY, ORDER, "level", "t", 3600.0, DAY).select("user_id", "t", F.round("stopped_for", 3).alias("stopped_for"))


def upward_jumps(spark, sf_dir):
    out = sequence.upward_jumps(events(spark, sf_dir), KEY, ORDER, "v", "t", 40.0, DAY)
    return out.select("event_id", "before", "v", "fall_at")


def switched_off(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("value")))
    return sequence.switched_off(ev, KEY, ORDER, "v", 2).select("event_id", "t")


def score_changes(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("score", F.sum((F.col("event_type") == "purchase").cast("long")).over(sequence.over(KEY, ORDER)))
    out = sequence.score_changes(ev, KEY, ORDER, "score", F.col("event_type") == "click", "t", F.col("event_type") == "error")
    return out.select("user_id", "t", "t_prev", "before", "after", "points", "hidden_between")


def lnds_mask(spark, sf_dir):
    return folds.chain_mask(events(spark, sf_dir).select("event_id", "user_id", "i", "value"), KEY, ORDER, "value").select("event_id", "on_chain")


def weighted_lnds(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "user_id", "i", "value", (F.pmod("event_id", F.lit(7)) + 1).cast("double").alias("w"))
    return folds.weighted_chain_mask(ev, KEY, ORDER, "value", "w").select("event_id", "on_chain")


def outlier_chain(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "user_id", "i", "v", (F.col("t") / 3600).alias("hours"))
    return folds.plausible_mask(ev, KEY, ORDER, "v", "hours", (24.0, 14.0), 48.0, 1.5).select("event_id", "plausible")


def clean_scores(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "user_id", "i", F.floor(F.col("i") / 6 + F.col("value") / 400).cast("double").alias("score_raw"), (F.col("event_type") != "error").alias("seen"), F.lit(False).alias("replay"))
    return folds.clean_scores(ev, KEY, ORDER, "score_raw", "seen", "replay").select("event_id", "score", "score_read", "behind")


def infer_period(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "user_id", "i", (100.0 - F.pmod("i", F.lit(20)) * 5 + F.col("value") / 1000).alias("clock"))
    return folds.infer_period(ev, KEY, ORDER, "clock", 100.0).select("event_id", "period")


def signature_reuse(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "user_id", "i", F.array(F.col("value"), F.col("value") / 2, F.lit(1.0)).alias("sig"), (F.col("event_type") != "error").alias("seen"))
    return folds.reuse_mask(ev, KEY, ORDER, "sig", "seen", 6.0, 60.0).select("event_id", "reused")


def changed_rows(spark, sf_dir):
    return summaries.changed_rows(events(spark, sf_dir), KEY, ORDER, ["event_type"]).select("event_id", "event_type")


W = "OVER (PARTITION BY user_id ORDER BY i"
ISLAND = f"SELECT *, sum(new) {W}) AS run FROM (SELECT *, CASE WHEN {{x}} IS DISTINCT FROM lag({{x}}) {W}) OR i = 0 THEN 1 ELSE 0 END AS new FROM {{src}})"

SQL = {
    "ffill": f"WITH {EV} SELECT event_id, last_value(v IGNORE NULLS) {W}) AS filled FROM ev",
    "head_backfill": f"WITH {EV} SELECT event_id, coalesce(last_value(v IGNORE NULLS) {W}), first_value(v IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled FROM ev",
    "interpolate_gaps": f"""WITH {EV}, n AS (
      SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) {W}) AS t0, last_value(v IGNORE NULLS) {W}) AS v0,
        first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1, first_value(v IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM ev)
      SELECT event_id, round(coalesce(v, CASE WHEN t1 > t0 AND t1 - t0 <= {DAY} THEN v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END), 6) AS line FROM n""",
    "nearest_known": f"""WITH {EV}, n AS (
      SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS i0, last_value(v IGNORE NULLS) {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v0,
        first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS i1, first_value(v IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS v1 FROM ev)
      SELECT event_id, CASE WHEN i1 IS NULL OR i - i0 <= i1 - i THEN v0 ELSE v1 END AS near FROM n""",
    "islands_gap": f"""WITH {EV}, c AS (SELECT *, CASE WHEN i - lag(i) {W}) > 2 THEN 1 ELSE 0 END AS new FROM ev WHERE event_type IN ('click', 'view', 'purchase')),
      r AS (SELECT *, sum(new) {W}) AS run FROM c) SELECT user_id, min(i)::BIGINT AS first, max(i)::BIGINT AS last, count(*) AS n FROM r GROUP BY user_id, run""",
    "state_runs": f"WITH {EV}, r AS ({ISLAND.format(x='event_type', src='ev')}) SELECT user_id, min(t) AS t_first, max(t) AS t_last FROM r GROUP BY user_id, run HAVING min(event_type) = 'error'",
    "rle": f"WITH {EV}, r AS ({ISLAND.format(x='event_type', src='ev')}) SELECT user_id, min(event_type) AS value, min(i)::BIGINT AS first, max(i)::BIGINT AS last, count(*) AS n FROM r GROUP BY user_id, run",
    "not_live_widened": f"""WITH {EV}, n AS (SELECT *, event_type = 'error' AS off, coalesce(lag(t) {W}), t - 0.5) AS lo, coalesce(lead(t) {W}), t + 0.5) AS hi FROM ev),
      r AS ({ISLAND.format(x='off', src='n')}) SELECT user_id, min(lo) AS a, max(hi) AS b FROM r WHERE off GROUP BY user_id, run""",
    "hold_changes": f"""WITH {EV}, r AS ({ISLAND.format(x='event_type', src='ev')}), h AS (SELECT user_id, min(event_type) AS new, min(i) AS i, min(t) AS t FROM r GROUP BY user_id, run HAVING count(*) >= 2)
      SELECT user_id, t, old, new FROM (SELECT *, lag(new) {W}) AS old FROM h) WHERE old <> new""",
    "change_times": f"WITH {EV}, m AS (SELECT *, max(v) {W}) AS top FROM ev) SELECT event_id, t, before, top AS after FROM (SELECT *, lag(top) {W}) AS before FROM m WHERE top IS NOT NULL) WHERE top > before",
    "running_flag": f"""WITH {EV}, n AS (SELECT *, max(v) {W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS hi, min(v) {W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS lo FROM ev)
      SELECT event_id, coalesce(hi > v + 0.05, false) OR coalesce(lo < v - 0.05, false) AS moves FROM n WHERE v IS NOT NULL""",
    "stopped_duration": f"""WITH {EV}, r AS ({ISLAND.format(x='event_type', src='ev')})
      SELECT event_id, round(t - min(t) OVER (PARTITION BY user_id, run ORDER BY t RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW), 3) AS held FROM r""",
    "range_max": f"""WITH {EV}, n AS (SELECT event_id, max({{'h': value, 't': t, 'v': event_type}}) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS best FROM ev)
      SELECT event_id, best.h AS longest, CASE WHEN best.h >= 60 THEN best.v END AS held_value FROM n""",
    "clock_restarts": f"""WITH {EV}, l AS (SELECT *, floor(value / 50)::BIGINT AS level FROM ev), r AS ({ISLAND.format(x='level', src='l')}),
      h AS (SELECT user_id, min(level) AS level, min(i) AS i, min(t) AS t0, max(t) AS t1 FROM r GROUP BY user_id, run),
      n AS (SELECT *, lead(level) {W}) AS l2, lead(t0) {W}) AS t2 FROM h)
      SELECT user_id, t2 AS t, round(t1 - t0, 3) AS stopped_for FROM n WHERE t1 - t0 >= 3600 AND l2 < level AND t2 - t1 <= {DAY}""",
    "upward_jumps": f"""WITH {EV}, k AS (SELECT *, lag(v) {W}) AS before, CASE WHEN lead(v) {W}) < v THEN lead(t) {W}) END AS f FROM ev WHERE v IS NOT NULL),
      n AS (SELECT *, first_value(f IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fall FROM k)
      SELECT event_id, before, v, CASE WHEN fall - t < {DAY} THEN fall END AS fall_at FROM n WHERE v >= before + 40""",
    "switched_off": f"""WITH {EV}, u AS (SELECT *, event_type IN ('click', 'view', 'purchase') AS known FROM ev), n AS (SELECT *, lag(known) {W}) AS k0, lead(known) {W}) AS k1 FROM u)
      SELECT event_id, t FROM n WHERE k0 AND NOT known AND NOT k1""",
    "score_changes": f"""WITH {EV}, s AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) {W})::BIGINT AS score, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) {W}) AS hid FROM ev),
      n AS (SELECT *, lag(score) {W}) AS before, lag(t) {W}) AS tp, lag(hid) {W}) AS hp,
        last_value(CASE WHEN event_type = 'click' THEN t END IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tr,
        last_value(CASE WHEN event_type = 'click' THEN hid END IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hr FROM s)
      SELECT user_id, t, coalesce(tr, tp) AS t_prev, before, score AS after, score - before AS points, greatest(0, hp - coalesce(hr, 0))::BIGINT AS hidden_between FROM n WHERE score > before""",
    "lnds_mask": """WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      g AS (SELECT user_id, list(value ORDER BY i) AS v, list(event_id ORDER BY i) AS ids, count(*) AS n FROM e GROUP BY user_id),
      fwd AS (SELECT user_id, v, ids, n, 0::BIGINT AS k, []::BIGINT[] AS l FROM g
        UNION ALL SELECT user_id, v, ids, n, k + 1, list_append(l, 1 + coalesce(list_max(list_transform(list_filter(range(1, k + 1), lambda j: v[j] <= v[k + 1]), lambda j: l[j])), 0)) FROM fwd WHERE k < n),
      full_ AS (SELECT user_id, ids, n, l, list_max(l) AS top FROM fwd WHERE k = n),
      back AS (SELECT user_id, ids, l, n + 1 AS pos, top AS want FROM full_
        UNION ALL SELECT user_id, ids, l, list_max(list_filter(range(1, pos), lambda j: l[j] = want)), want - 1 FROM back WHERE want > 0)
      SELECT e.event_id, b.user_id IS NOT NULL AS on_chain FROM e LEFT JOIN (SELECT DISTINCT user_id, ids[pos] AS event_id FROM back b WHERE pos <= len(ids)) b ON e.user_id = b.user_id AND e.event_id = b.event_id""",
    "weighted_lnds": """WITH RECURSIVE e AS (SELECT event_id, user_id, value, (event_id % 7 + 1)::DOUBLE AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      g AS (SELECT user_id, list(value ORDER BY i) AS v, list(w ORDER BY i) AS w, list(event_id ORDER BY i) AS ids, count(*) AS n FROM e GROUP BY user_id),
      fwd AS (SELECT user_id, v, w, ids, n, 0::BIGINT AS k, []::DOUBLE[] AS best, []::BIGINT[] AS prev FROM g
        UNION ALL SELECT user_id, v, w, ids, n, k + 1, list_append(best, w[k + 1] + m), list_append(prev, CASE WHEN m > 0 THEN list_min(list_filter(range(1, k + 1), lambda j: v[j] <= v[k + 1] AND best[j] = m)) ELSE 0 END)
        FROM (SELECT *, coalesce(list_max(list_transform(list_filter(range(1, k + 1), lambda j: v[j] <= v[k + 1]), lambda j: best[j])), 0) AS m FROM fwd WHERE k < n)),
      full_ AS (SELECT user_id, ids, prev, list_min(list_filter(range(1, n + 1), lambda j: best[j] = list_max(best))) AS last FROM fwd WHERE k = n),
      back AS (SELECT user_id, ids, prev, last AS pos FROM full_ UNION ALL SELECT user_id, ids, prev, prev[pos] FROM back WHERE prev[pos] > 0)
      SELECT e.event_id, b.event_id IS NOT NULL AS on_chain FROM e LEFT JOIN (SELECT ids[pos] AS event_id FROM back) b ON e.event_id = b.event_id""",
    "clean_scores": f"""WITH RECURSIVE {EV}, x AS (SELECT event_id, user_id, i, floor(i / 6 + value / 400) AS v, event_type <> 'error' AS e FROM ev),
      known AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY i) AS pv FROM x WHERE e AND v IS NOT NULL),
      r0 AS (SELECT *, sum((pv IS NULL OR v <> pv)::INT) OVER (PARTITION BY user_id ORDER BY i) AS run FROM known),
      runs AS (SELECT user_id, run, any_value(v) AS v, min(i) AS f, max(i) AS l, count(*) AS n FROM r0 GROUP BY 1, 2),
      seen AS (SELECT *, max(CASE WHEN n >= 2 THEN v END) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM runs),
      bound AS (SELECT a.user_id, a.run, min(b.run) AS stop FROM seen a JOIN runs b ON a.user_id = b.user_id AND b.run > a.run AND b.v <> a.v AND b.v > least(a.v, coalesce(a.s, -1e18)) GROUP BY 1, 2),
      backed AS (SELECT a.user_id, a.run, coalesce(sum(b.n), 0) AS support FROM seen a LEFT JOIN bound o ON o.user_id = a.user_id AND o.run = a.run LEFT JOIN runs b ON b.user_id = a.user_id AND b.run > a.run AND b.v = a.v AND a.n >= 2 AND (o.stop IS NULL OR b.run < o.stop) GROUP BY 1, 2),
      k AS (SELECT r.*, (r.n + support)::DOUBLE AS w, row_number() OVER (PARTITION BY r.user_id ORDER BY r.run) AS k FROM runs r JOIN backed b ON b.user_id = r.user_id AND b.run = r.run WHERE r.n >= 2),
      g AS (SELECT user_id, list(v ORDER BY k) AS v, list(w ORDER BY k) AS w, count(*) AS n FROM k GROUP BY user_id),
      fwd AS (SELECT user_id, v, w, n, 0::BIGINT AS k, []::DOUBLE[] AS best, []::BIGINT[] AS prev FROM g
        UNION ALL SELECT user_id, v, w, n, k + 1, list_append(best, w[k + 1] + m), list_append(prev, CASE WHEN m > 0 THEN list_min(list_filter(range(1, k + 1), lambda j: v[j] <= v[k + 1] AND best[j] = m)) ELSE 0 END)
        FROM (SELECT *, coalesce(list_max(list_transform(list_filter(range(1, k + 1), lambda j: v[j] <= v[k + 1]), lambda j: best[j])), 0) AS m FROM fwd WHERE k < n)),
      full_ AS (SELECT user_id, prev, list_min(list_filter(range(1, n + 1), lambda j: best[j] = list_max(best))) AS last FROM fwd WHERE k = n),
      back AS (SELECT user_id, prev, last AS pos FROM full_ UNION ALL SELECT user_id, prev, prev[pos] FROM back WHERE prev[pos] > 0),
      kept AS (SELECT k.* FROM k JOIN back ON back.user_id = k.user_id AND back.pos = k.k),
      gone AS (SELECT o.user_id, o.f, o.l FROM (SELECT k.* FROM k ANTI JOIN kept ON kept.user_id = k.user_id AND kept.k = k.k WHERE k.n >= 3) o ASOF JOIN kept ON kept.user_id = o.user_id AND o.f > kept.f WHERE o.v < kept.v)
      SELECT x.event_id, coalesce(a.v, (SELECT arg_min(c.v, c.f) FROM kept c WHERE c.user_id = x.user_id)) AS score, coalesce(x.e AND x.i <= a.l AND x.v = a.v, false) AS score_read,
        EXISTS (SELECT 1 FROM gone WHERE gone.user_id = x.user_id AND x.i BETWEEN gone.f AND gone.l) AS behind
      FROM x ASOF LEFT JOIN kept a ON a.user_id = x.user_id AND x.i >= a.f""",
    "signature_reuse": f"""WITH RECURSIVE {EV}, f AS (
        SELECT user_id, -1::BIGINT AS i, NULL::BIGINT AS event_id, NULL::DOUBLE AS last, false AS reused FROM (SELECT DISTINCT user_id FROM ev)
        UNION ALL
        SELECT user_id, i, event_id, CASE WHEN off THEN NULL WHEN same THEN last ELSE value END, same FROM (
          SELECT e.user_id, e.i, e.event_id, f.last, e.value, e.event_type = 'error' AS off,
            coalesce(e.event_type <> 'error' AND (abs(e.value - f.last) + abs(e.value / 2 - f.last / 2)) / 3 < 6 AND abs(e.value - f.last) < 60, false) AS same
          FROM f JOIN ev e ON e.user_id = f.user_id AND e.i = f.i + 1))
      SELECT event_id, reused FROM f WHERE i >= 0""",
    "outlier_chain": f"""WITH RECURSIVE {EV}, k AS (SELECT event_id, user_id, t / 3600 AS h, v, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM ev WHERE v IS NOT NULL),
      f AS (
        SELECT user_id, 0::BIGINT AS n, NULL::DOUBLE AS th, NULL::DOUBLE AS tv, []::STRUCT(id BIGINT, h DOUBLE, v DOUBLE)[] AS waiting, []::BIGINT[] AS dropped FROM (SELECT DISTINCT user_id FROM k)
        UNION ALL
        SELECT user_id, n, CASE WHEN ok OR moved THEN h ELSE th END, CASE WHEN ok OR moved THEN v ELSE tv END, CASE WHEN ok OR moved THEN [] ELSE now END, CASE WHEN ok OR breaks THEN list_transform(waiting, lambda w: w.id) ELSE [] END FROM (
          SELECT *, NOT ok AND len(now) >= 4 AND h - now[1].h >= 1.5 AS moved FROM (
            SELECT *, list_append(CASE WHEN breaks THEN [] ELSE waiting END, {{'id': id, 'h': h, 'v': v}}) AS now FROM (
              SELECT k.user_id, k.n, k.event_id AS id, k.h, k.v, f.th, f.tv, f.waiting,
                f.th IS NULL OR k.h - f.th > 48 OR (k.v >= f.tv - (k.h - f.th) - 1 AND k.v <= f.tv + 0.01) OR ((abs(k.v - 24) < 0.01 OR abs(k.v - 14) < 0.01) AND k.v >= f.tv - (k.h - f.th) - 1) AS ok,
                len(f.waiting) > 0 AND NOT coalesce(k.v >= f.waiting[-1].v - (k.h - f.waiting[-1].h) - 1 AND k.v <= f.waiting[-1].v + 0.01, false) AS breaks
              FROM f JOIN k ON k.user_id = f.user_id AND k.n = f.n + 1)))),
      gone AS (SELECT unnest(dropped) AS id FROM f UNION SELECT unnest(list_transform(waiting, lambda w: w.id)) FROM f JOIN (SELECT user_id, max(n) AS n FROM f GROUP BY 1) USING (user_id, n))
      SELECT event_id, v IS NOT NULL AND event_id NOT IN (SELECT id FROM gone) AS plausible FROM ev""",
    "infer_period": f"""WITH RECURSIVE {EV}, c AS (SELECT user_id, event_id, i, 100.0::DOUBLE - (i % 20) * 5 + value / 1000 AS c FROM ev), g AS (SELECT user_id, list(c ORDER BY i) AS l, list(event_id ORDER BY i) AS ids, count(*) AS n FROM c GROUP BY 1),
      f AS (
        SELECT user_id, l, ids, n, 0::BIGINT AS k, 1::BIGINT AS period, l[1] AS low FROM g
        UNION ALL
        SELECT user_id, l, ids, n, k + 1, CASE WHEN up THEN period + 1 ELSE period END, least(CASE WHEN up THEN l[k + 1] ELSE low END, l[k + 1])
        FROM (SELECT *, l[k + 1] > low + 0.4::DOUBLE * 100 AND list_avg(list_transform(l[k + 1:k + 8], lambda x: CASE WHEN x > low + 0.4::DOUBLE * 100 THEN 1.0::DOUBLE ELSE 0.0 END)) >= 0.7 AS up FROM f WHERE k < n))
      SELECT ids[k] AS event_id, period::DOUBLE AS period FROM f WHERE k > 0""",
    "changed_rows": f"WITH {EV} SELECT event_id, event_type FROM (SELECT *, lag(event_type) {W}) AS p FROM ev) WHERE event_type IS DISTINCT FROM p",
}

QUERIES = {
    f.__name__: f
    for f in (
        ffill, head_backfill, interpolate_gaps, nearest_known, islands_gap, state_runs, rle, not_live_widened, hold_changes, change_times, running_flag, stopped_duration, range_max, clock_restarts,
        upward_jumps, switched_off, score_changes, lnds_mask, weighted_lnds, outlier_chain, clean_scores, infer_period, signature_reuse, changed_rows,
    )
}
