"""Queries of alignments, summaries, arrays, sources and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import geometry
from tidemark.operators import alignment, arrays, sequence, summaries
from tidemark.plans.q_sequence import DAY, EV, KEY, ORDER, events
from tidemark.sources import feeds, files
from tidemark.sources.files import micros, table
from tidemark.sources.scratch import Scratch

RUNNING = f"""{EV}, r AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i)::BIGINT AS own,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i)::BIGINT AS opp FROM ev)"""


def _running(spark, sf_dir):
    w = sequence.over(KEY, ORDER)
    count = lambda kind: F.sum((F.col("event_type") == kind).cast("long")).over(w)
    return events(spark, sf_dir).withColumn("own", count("purchase")).withColumn("opp", count("error"))


def largest_deficit(spark, sf_dir):
    """Per user: the error at which errors led purchases most, the latest of equals."""
    theirs = _running(spark, sf_dir).filter("event_type = 'error'")
    return summaries.largest_deficit(theirs, KEY, "own", "opp", ["i"], ["event_id", "own", "opp"])


def running_score(spark, sf_dir):
    return _running(spark, sf_dir).select("event_id", "own", "opp")


def score_fold_exact(spark, sf_dir):
    """The exact fold of running pairs that now and then fall back."""
    ev = events(spark, sf_dir)
    pair = F.struct("i", F.floor(F.col("i") / 2 + F.col("value") / 50).cast("int").alias("home"), F.floor(F.col("i") / 3 + F.col("value") / 40).cast("int").alias("away"))
    per = ev.groupBy("user_id").agg(F.array_sort(F.collect_list(pair)).alias("rows"))
    steps = feeds.score_fold(F.transform("rows", lambda r: F.struct(r["home"].alias("home"), r["away"].alias("away"))))
    return per.select("user_id", F.explode(steps).alias("s")).select("user_id", F.col("s.at").cast("long").alias("at"), "s.side", "s.points", "s.home", "s.away")


def _kind(spark, sf_dir, kind):
    return events(spark, sf_dir).filter(F.col("event_type") == kind).select("event_id", "user_id", "t")


def asof_backward(spark, sf_dir):
    return alignment.asof(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "click"), KEY, "t", ["event_id"]).select("event_id", "match_t", "match_event_id")


def asof_forward(spark, sf_dir):
    return alignment.asof(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "click"), KEY, "t", ["event_id"], forward=True).select("event_id", "match_t", "match_event_id")


def asof_tolerance(spark, sf_dir):
    return alignment.asof(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "click"), KEY, "t", ["event_id"], within=DAY / 2).select("event_id", "match_t", "match_event_id")


def median_lag(spark, sf_dir):
    lag = alignment.asof(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "click"), KEY, "t", [], within=DAY).withColumn("lag", F.col("t") - F.col("match_t"))
    return summaries.median_if_enough(lag, KEY, "lag", 4).select("user_id", F.round("median", 3).alias("median"), "n")


def _changes_and_plays(spark, sf_dir):
    # both are read several times, the numbering of events is done once
    ev = Scratch(spark, "matches").write(_running(spark, sf_dir).filter("event_type = 'purchase'"), "purchases")
    changes = ev.select("user_id", F.col("event_id").alias("change_id"), (F.col("own") - 1 - F.col("event_id") % 2).alias("before"), F.col("own").alias("after"), (1 + F.col("event_id") % 2).alias("points"), F.floor(F.col("t") / (7 * DAY)).cast("long").alias("period"), (F.col("t") / 3600).alias("clock"))
    plays = ev.select("user_id", F.col("event_id").alias("play_id"), F.col("own").alias("score"), F.lit(1).cast("long").alias("points"), F.floor(F.col("t") / (7 * DAY)).cast("long").alias("period"), (F.col("t") / 3600 + F.col("value") / 20).alias("clock"))
    return changes, plays


def chain_lookup(spark, sf_dir):
    changes, plays = _changes_and_plays(spark, sf_dir)
    out = alignment.chain_lookup(changes, plays.select("user_id", "play_id", "score", "points"), KEY)
    return out.select("user_id", "change_id", F.array_join(F.transform("plays", lambda p: p.cast("string")), ",").alias("plays"))


def greedy_match(spark, sf_dir):
    changes, plays = _changes_and_plays(spark, sf_dir)
    out = alignment.greedy_match(changes, plays, KEY)
    return out.select("user_id", "change_id", F.array_join(F.transform("play_ids", lambda p: p.cast("string")), ",").alias("plays"), "how", F.round("clock_diff", 6).alias("clock_diff"))


def match_summary(spark, sf_dir):
    changes, plays = _changes_and_plays(spark, sf_dir)
    matches = Scratch(spark, "matches").write(alignment.greedy_match(changes, plays, KEY), "matches")  # read three times
    return alignment.match_summary(matches, changes, plays, KEY)


def unmatched_both(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    left = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id"))
    p, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    right = p.join(line, p["p_partkey"] == line["l_partkey"], "left_anti").select(F.lit("part").alias("side"), F.col("p_partkey").alias("id"))
    return left.unionByName(right)


def fuzzy_code_join(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "nation").select(F.substring("n_name", 1, 3).alias("code"))
    return alignment.same_code_join(n, r, "n_name", "code")


def source_fallback(spark, sf_dir):
    ev = events(spark, sf_dir)
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    day = F.floor(F.col("t") / DAY).cast("long")
    return alignment.first_source(ev.withColumn("priority", rank).withColumn("day", day), ["user_id", "day"], "priority").select("user_id", "day", "event_id", "priority")


def edit_carryover(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    clips = o.filter("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("play"), "o_orderstatus", (micros(F.col("o_orderdate")) / 1e6).alias("at"), "o_custkey")
    edits = o.filter("o_orderpriority <> '1-URGENT'").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("play"), "o_orderstatus", (micros(F.col("o_orderdate")) / 1e6).alias("at"), "o_custkey", F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("id"))
    key = alignment.play_key(F.col("play"), F.col("o_orderstatus"), F.round("at", 1).cast("long"), F.col("o_custkey"))
    return alignment.carried_edits(clips, edits, key, key, ["note", "id"]).select("o_orderkey", "edit_note", "edit_id")


def prefix_cutlist(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w)
    return o.select("o_custkey", "o_orderkey", (cents - F.round(F.col("o_totalprice") * 100).cast("long")).alias("out_start"), cents.alias("out_end"))


def latest_with_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return summaries.latest_with_count(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "n")


def oldest_until_room(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return summaries.oldest_until_room(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents", F.lit(50_000_000)).select("o_custkey", "o_orderkey", "freed_before")


def eta(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", summaries.eta((F.col("o_custkey") % 600).cast("double"), (F.col("o_orderkey") % 100) / 100.0).alias("eta"))


def retention_sweep(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    uses = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", ((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).alias("busy"))
    last = uses.agg(F.max("o_orderdate").alias("newest")).first()["newest"]
    before = F.lit(last) - F.expr("interval 120 days")
    return summaries.stale_files(c.select("c_custkey"), uses, "c_custkey", "o_orderdate", "busy", before)


def top3_scorers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return summaries.top_by_sum(o, ["o_orderstatus"], "o_custkey", "cents", "o_orderkey", 3)


def sides_first_seen(spark, sf_dir):
    return summaries.first_seen(events(spark, sf_dir), KEY, "event_type", "i")


def mode_label(spark, sf_dir):
    return summaries.commonest(events(spark, sf_dir), KEY, "event_type")


def ordered_distinct_concat(spark, sf_dir):
    return summaries.ordered_distinct(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn", "roles")


def read_rates(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    both = d.join(lab, "doc_id", "left")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("quality").isNotNull().cast("int")), 4).alias("seen"), F.round(F.avg("quality"), 4).alias("good"), F.min_by("doc_id", F.when(F.col("quality") == 0, F.col("doc_id"))).alias("first_bad"))


def confidence_penalty(spark, sf_dir):
    ev = events(spark, sf_dir).groupBy("user_id").agg((F.min("value") / 10).alias("least"), (F.max("value") > 150).alias("trimmed"), F.bool_or(F.col("event_type") == "error").alias("warned"))
    return ev.select("user_id", summaries.clip_confidence(F.col("least"), F.col("trimmed"), F.col("warned")).alias("confidence"))


def quality_ratios(spark, sf_dir):
    ev = events(spark, sf_dir)
    miss = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    per = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNotNull()).alias("live"), miss("click").alias("a"), miss("view").alias("b"))
    return per.select("user_id", "n", "live", F.round(F.col("live") / F.greatest(F.lit(1), F.col("n")), 4).alias("share"), summaries.one_sided(F.col("a"), F.col("b")).alias("side"))


def rate_limit_window(spark, sf_dir):
    return summaries.recent_count(events(spark, sf_dir), KEY, "t", 2 * DAY, F.col("event_type") == "error").select("event_id", "recent")


def budget_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.lit(1).alias("units"))
    prices = o.select("o_orderpriority").distinct().withColumn("price", F.substring("o_orderpriority", 1, 1).cast("int"))
    return summaries.spent(o, prices, ["o_custkey"], "o_orderpriority", 30)


def grid_chunks(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), (F.col("o_custkey") % 7 * 0.3).alias("start"), (F.col("o_orderkey") % 900).cast("double").alias("end"))
    return files.chunks(g).select("game_id", "chunk", "start", "seconds")


def settled_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("polled_at"), F.floor(F.col("o_totalprice") / 100_000).cast("long").alias("size"), "o_orderkey")
    one = o.groupBy("path", "polled_at").agg(F.min_by("size", "o_orderkey").alias("size"))
    return files.settled(one)


def _boxes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = lambda k: F.abs(F.col("embedding")[k].cast("double"))
    return e.select("vec_id", "label", geometry.box(x(0), x(1), x(0) + x(2) + 0.2, x(1) + x(3) + 0.1).alias("a"), geometry.box(x(4), x(5), x(4) + x(6) + 0.2, x(5) + x(7) + 0.1).alias("b"))


def box_iou(spark, sf_dir):
    return _boxes(spark, sf_dir).select("vec_id", F.round(geometry.iou(F.col("a"), F.col("b")), 9).alias("iou"))


def crop_rule(spark, sf_dir):
    c = geometry.vertical_crop(F.col("a"), F.lit(1280), F.lit(720))
    return _boxes(spark, sf_dir).withColumn("c", c).select("vec_id", "c.x", "c.w", "c.h")


def median_box(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    mid = b.groupBy("label").agg(F.median("a.y0").alias("my"))
    kept = b.join(mid, "label").filter(F.abs(F.col("a.y0") - F.col("my")) <= 0.06)
    return kept.groupBy("label").agg(*(F.round(F.median(f"a.{c}"), 9).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _images(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("px"))


def ncc_similarity(spark, sf_dir):
    """Each vector against its label's first one."""
    e = _images(spark, sf_dir)
    first = e.groupBy("label").agg(F.min_by("px", "vec_id").alias("ref"))
    return e.join(first, "label").select("vec_id", F.round(arrays.correlation(F.col("px"), F.col("ref")), 6).alias("ncc"), F.round(arrays.mean_difference(F.col("px"), F.col("ref")), 6).alias("mad"))


def median_reference(spark, sf_dir):
    out = arrays.position_medians(_images(spark, sf_dir), ["label"], "px")
    return out.select("label", F.col("at").cast("long").alias("at"), F.round("median", 6).alias("median"), F.round("std", 6).alias("std"))


def static_mask(spark, sf_dir):
    return arrays.steady_share(_images(spark, sf_dir), ["label"], "px", 0.3).select("label", F.round("steady", 6).alias("steady"))


def hist_peak_share(spark, sf_dir):
    return arrays.common_bins(_images(spark, sf_dir), ["label"], "px", 0.05, 0.25)


def better_half(spark, sf_dir):
    return _images(spark, sf_dir).select("vec_id", F.round(arrays.better_half(F.col("px")), 9).alias("top"))


def ctc_collapse(spark, sf_dir):
    best = F.transform("px", lambda x: F.pmod(F.floor(x * 10).cast("int"), F.lit(4)))
    return _images(spark, sf_dir).select("vec_id", F.array_join(F.transform(arrays.collapsed(best), lambda x: x.cast("string")), "").alias("text"))


def ink_runs(spark, sf_dir):
    r = arrays.ink_runs(F.col("px"), 0.1)
    return _images(spark, sf_dir).select("vec_id", F.explode(r).alias("r")).select("vec_id", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


def batch_rows(spark, sf_dir):
    """Rows of an entity in batches of eight."""
    ev = events(spark, sf_dir)
    return ev.groupBy("user_id", F.floor(F.col("i") / 8).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def _asof_sql(join: str, within: str = "") -> str:
    m = "CASE WHEN abs(p.t - c.t) <= 43200 THEN {} END" if within else "{}"
    return f"WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT * FROM ev WHERE event_type = 'click') SELECT p.event_id, {m.format('c.t')} AS match_t, {m.format('c.event_id')} AS match_event_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t {join} c.t"


BOXES = """e AS (SELECT vec_id, label, abs(embedding[1]::DOUBLE) AS p0, abs(embedding[2]::DOUBLE) AS p1, abs(embedding[3]::DOUBLE) AS p2, abs(embedding[4]::DOUBLE) AS p3, abs(embedding[5]::DOUBLE) AS p4, abs(embedding[6]::DOUBLE) AS p5, abs(embedding[7]::DOUBLE) AS p6, abs(embedding[8]::DOUBLE) AS p7 FROM embeddings),
  b AS (SELECT vec_id, label, least(1, p0) AS ax0, least(1, p1) AS ay0, least(1, p0 + p2 + 0.2::DOUBLE) AS ax1, least(1, p1 + p3 + 0.1::DOUBLE) AS ay1, least(1, p4) AS bx0, least(1, p5) AS by0, least(1, p4 + p6 + 0.2::DOUBLE) AS bx1, least(1, p5 + p7 + 0.1::DOUBLE) AS by1 FROM e)"""
PX = "px AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS px FROM embeddings)"
CELLS = f"{PX}, cells AS (SELECT vec_id, label, unnest(px) AS x, generate_subscripts(px, 1) - 1 AS pos FROM px)"
PLAYS = f"""{RUNNING}, ch AS (SELECT user_id, event_id AS change_id, own - 1 - event_id % 2 AS before, own AS after, 1 + event_id % 2 AS points FROM r WHERE event_type = 'purchase'),
  pl AS (SELECT user_id, event_id AS play_id, own AS score FROM r WHERE event_type = 'purchase')"""

#: Candidates in the order of their turns, then the choice of one after the other.
MATCHED = f"""{EV}, own AS (SELECT user_id, event_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY i) AS own, floor(t / (7 * {DAY}))::BIGINT AS period, t / 3600 AS clock FROM ev WHERE event_type = 'purchase'),
  c AS (SELECT user_id, event_id AS change_id, own - 1 - event_id % 2 AS before, own AS after, 1 + event_id % 2 AS points, period, clock FROM own), y AS (SELECT user_id, event_id AS play_id, own AS score, period, clock + value / 20 AS clock FROM own),
  steps AS (SELECT c.user_id, change_id, any_value(points) AS points, count(*) AS worth, list(play_id ORDER BY score) AS ids, max(after) AS after FROM c JOIN y ON y.user_id = c.user_id AND y.score > before AND y.score <= after GROUP BY 1, 2),
  chain AS (SELECT s.user_id, s.change_id, ids, abs(c.clock - y.clock) AS diff FROM steps s JOIN c ON c.user_id = s.user_id AND c.change_id = s.change_id JOIN y ON y.user_id = s.user_id AND y.play_id = ids[-1] WHERE worth = s.points AND c.period = y.period),
  cand AS (SELECT user_id, change_id, CASE WHEN diff <= 3 THEN 1 ELSE 3 END AS turn, ids, diff FROM chain WHERE diff <= 30 OR diff IS NULL
    UNION ALL SELECT c.user_id, change_id, 2, [play_id], abs(c.clock - y.clock) FROM c JOIN y ON y.user_id = c.user_id AND y.period = c.period AND c.points = 1 AND abs(c.clock - y.clock) <= 3.000001::DOUBLE),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn, change_id, diff, ids[1] DESC) AS r FROM cand),
  f AS (SELECT DISTINCT user_id, 0::BIGINT AS r, []::BIGINT[] AS owners, []::BIGINT[] AS gone, NULL::BIGINT AS change_id, NULL::BIGINT[] AS ids, 0 AS turn, NULL::DOUBLE AS diff, false AS kept FROM ranked
    UNION ALL SELECT user_id, r, CASE WHEN ok THEN list_append(owners, change_id) ELSE owners END, CASE WHEN ok THEN list_concat(gone, ids) ELSE gone END, change_id, ids, turn, diff, ok FROM (
      SELECT n.user_id, n.r, f.owners, f.gone, n.change_id, n.ids, n.turn, n.diff, NOT list_contains(f.owners, n.change_id) AND NOT list_has_any(f.gone, n.ids) AS ok FROM f JOIN ranked n ON n.user_id = f.user_id AND n.r = f.r + 1)),
  matched AS (SELECT user_id, change_id, ids, diff, CASE WHEN len(ids) > 1 THEN 'merged' WHEN turn = 3 THEN 'score' ELSE 'clock' END AS how FROM f WHERE kept)"""
SQL = {
    "greedy_match": f"WITH RECURSIVE {MATCHED} SELECT user_id, change_id, array_to_string(ids, ',') AS plays, how, round(diff, 6) AS clock_diff FROM matched",
    "match_summary": f"""WITH RECURSIVE {MATCHED}, m AS (SELECT user_id, count(*) AS matched, count(*) FILTER (how = 'clock') AS by_clock FROM matched GROUP BY 1),
      u AS (SELECT user_id, count(*) AS n FROM c ANTI JOIN matched USING (user_id, change_id) GROUP BY 1), v AS (SELECT user_id, count(*) AS n FROM y ANTI JOIN (SELECT user_id, unnest(ids) AS play_id FROM matched) USING (user_id, play_id) GROUP BY 1)
      SELECT user_id, coalesce(matched, 0) AS matched, coalesce(by_clock, 0) AS by_clock, coalesce(u.n, 0) AS unmatched_changes, coalesce(v.n, 0) AS unmatched_plays FROM m FULL JOIN u USING (user_id) FULL JOIN v USING (user_id)""",
    "largest_deficit": f"WITH {RUNNING}, d AS (SELECT *, opp - own AS deficit FROM r WHERE event_type = 'error' AND opp > own), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY deficit DESC, i DESC) AS rn FROM d) SELECT user_id, event_id, own, opp, deficit FROM k WHERE rn = 1",
    "running_score": f"WITH {RUNNING} SELECT event_id, own, opp FROM r",
    "score_fold_exact": f"""WITH RECURSIVE {EV}, p AS (SELECT user_id, i, floor(i / 2.0::DOUBLE + value / 50)::INT AS h, floor(i / 3.0::DOUBLE + value / 40)::INT AS a FROM ev),
      f AS (SELECT user_id, -1::BIGINT AS i, 0 AS h, 0 AS a, NULL::VARCHAR AS side, 0 AS points, 0 AS home, 0 AS away FROM (SELECT DISTINCT user_id FROM p)
        UNION ALL SELECT p.user_id, p.i, CASE WHEN p.h > f.h OR p.a > f.a THEN p.h ELSE greatest(p.h, f.h) END, CASE WHEN p.h > f.h OR p.a > f.a THEN p.a ELSE greatest(p.a, f.a) END,
          CASE WHEN p.h > f.h THEN 'home' WHEN p.a > f.a THEN 'away' END, CASE WHEN p.h > f.h THEN p.h - f.h ELSE p.a - f.a END, p.h, p.a FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1)
      SELECT user_id, i AS at, side, points, home, away FROM f WHERE side IS NOT NULL""",
    "asof_backward": _asof_sql(">="),
    "asof_forward": _asof_sql("<="),
    "asof_tolerance": _asof_sql(">=", "within"),
    "median_lag": f"WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT * FROM ev WHERE event_type = 'click'), l AS (SELECT p.user_id, CASE WHEN p.t - c.t <= {DAY} THEN p.t - c.t END AS lag FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t >= c.t) SELECT user_id, round(CASE WHEN count(lag) >= 4 THEN median(lag) END, 3) AS median, count(lag) AS n FROM l GROUP BY user_id",
    "chain_lookup": f"WITH {PLAYS} SELECT ch.user_id, change_id, string_agg(play_id::VARCHAR, ',' ORDER BY score) AS plays FROM ch JOIN pl ON ch.user_id = pl.user_id AND score > before AND score <= after GROUP BY ch.user_id, change_id, points HAVING count(*) = points",
    "unmatched_both": "SELECT 'customer' AS side, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "fuzzy_code_join": "SELECT a.n_name, left(b.n_name, 3) AS code FROM nation a, nation b WHERE starts_with(upper(a.n_name), upper(left(b.n_name, 3))) OR left(upper(a.n_name), 2) = left(upper(b.n_name), 2)",
    "source_fallback": f"WITH {EV}, p AS (SELECT *, floor(t / {DAY})::BIGINT AS day, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS priority FROM ev) SELECT user_id, day, event_id, priority FROM (SELECT *, min(priority) OVER (PARTITION BY user_id, day) AS best FROM p) WHERE priority = best",
    "edit_carryover": """WITH k AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'play|' || o_orderkey ELSE 'seen|' || o_orderstatus || '|' || round(epoch_us(o_orderdate) / 1e6, 1)::BIGINT || '|' || o_custkey END AS key FROM orders)
      SELECT c.o_orderkey, e.o_orderpriority AS edit_note, e.o_orderkey AS edit_id FROM (SELECT * FROM k WHERE o_orderstatus <> 'P') c FULL JOIN (SELECT * FROM k WHERE o_orderpriority <> '1-URGENT') e ON c.key = e.key""",
    "prefix_cutlist": "WITH c AS (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders) SELECT o_custkey, o_orderkey, (e - cents)::BIGINT AS out_start, e::BIGINT AS out_end FROM (SELECT *, sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e FROM c)",
    "latest_with_count": "SELECT o_custkey, o_orderkey, n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "oldest_until_room": "WITH c AS (SELECT *, coalesce(sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before FROM orders) SELECT o_custkey, o_orderkey, freed_before FROM c WHERE freed_before < 50000000",
    "eta": "WITH o AS (SELECT o_orderkey, (o_custkey % 600)::DOUBLE AS e, (o_orderkey % 100) / 100.0::DOUBLE AS f FROM orders) SELECT o_orderkey, CASE WHEN f >= 0.03 AND e >= 4 THEN greatest(5, round_even(e * (1.0::DOUBLE - f) / f / 5, 0) * 5)::DOUBLE END AS eta FROM o",
    "retention_sweep": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') OR max(o_orderdate) >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 120 DAY)",
    "top3_scorers": "WITH s AS (SELECT o_orderstatus, o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY total DESC, f, o_custkey)::INT AS rank FROM s) SELECT o_orderstatus, o_custkey, total, rank FROM k WHERE rank <= 3",
    "sides_first_seen": f"WITH {EV} SELECT user_id, event_type FROM ev WHERE i = 0",
    "mode_label": f"WITH {EV}, n AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM n) WHERE r = 1",
    "ordered_distinct_concat": "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2) SELECT conv_id, string_agg(role, ' / ' ORDER BY t, role) AS roles FROM f GROUP BY conv_id",
    "read_rates": "SELECT lang, count(*) AS n, round(avg(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END), 4) AS seen, round(avg(quality), 4) AS good, min(CASE WHEN quality = 0 THEN d.doc_id END) AS first_bad FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang",
    "confidence_penalty": "WITH u AS (SELECT user_id, min(value) / 10 AS m, max(value) > 150 AS t, bool_or(event_type = 'error') AS w FROM events GROUP BY 1) SELECT user_id, round((0.5::DOUBLE + 0.5::DOUBLE * least(1, greatest(0, m))) * CASE WHEN t THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN w THEN 0.8::DOUBLE ELSE 1 END, 3) AS confidence FROM u",
    "quality_ratios": "WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS live, avg((event_type = 'click')::INT) AS a, avg((event_type = 'view')::INT) AS b FROM events GROUP BY 1) SELECT user_id, n, live, round(live / greatest(1, n), 4) AS share, CASE WHEN a > 0.3 AND a > 2 * b THEN 'a' WHEN b > 0.3 AND b > 2 * a THEN 'b' END AS side FROM u",
    "rate_limit_window": f"WITH {EV} SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM ev",
    "budget_gate": "SELECT o_custkey, sum(left(o_orderpriority, 1)::INT)::BIGINT AS cost, sum(left(o_orderpriority, 1)::INT) > 30 AS over FROM orders GROUP BY 1",
    "grid_chunks": """WITH g AS (SELECT o_orderkey AS game_id, ceil(o_custkey % 7 * 0.3::DOUBLE * 2 - 1e-9)::BIGINT AS f, ceil((o_orderkey % 900) * 2.0::DOUBLE - 1e-9)::BIGINT AS l FROM orders), k AS (SELECT *, unnest(range(f, l, 300)) AS k FROM g)
      SELECT game_id, ((k - f) // 300)::INT AS chunk, k / 2.0::DOUBLE AS start, least(300, l - k) / 2.0::DOUBLE AS seconds FROM k""",
    "settled_files": """WITH o AS (SELECT o_custkey AS path, o_orderdate AS polled_at, arg_min(floor(o_totalprice / 100000)::BIGINT, o_orderkey) AS size FROM orders GROUP BY 1, 2), s AS (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY polled_at) AS b FROM o)
      SELECT path, arg_min(size, polled_at) AS size, min(polled_at) AS polled_at FROM s WHERE size = b GROUP BY path""",
    "box_iou": f"WITH {BOXES}, c AS (SELECT *, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS m, (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) AS s FROM b) SELECT vec_id, round(CASE WHEN s - m > 0 THEN m / (s - m) ELSE 0 END, 9)::DOUBLE AS iou FROM c",
    "crop_rule": f"""WITH {BOXES}, w AS (SELECT *, least(1280, (ax1 - ax0) * 1280 / 0.78::DOUBLE) AS own FROM b),
      c AS (SELECT *, own >= 720 AS wide, least(1280, greatest(2, CASE WHEN own >= 720 THEN 2 * round_even(own / 2, 0) ELSE 2 * round_even(1.18::DOUBLE * 720 / 2, 0) END))::INT AS w FROM w),
      x AS (SELECT *, round_even((ax0 + ax1) / 2 * 1280 - w / 2.0::DOUBLE, 0)::INT AS centred, CASE WHEN ax0 * 1280 < round_even(640 - w / 2.0::DOUBLE, 0) THEN floor(ax0 * 1280) ELSE round_even(640 - w / 2.0::DOUBLE, 0) END AS l FROM c)
      SELECT vec_id, greatest(0, least(1280 - w, CASE WHEN wide THEN centred WHEN ax1 * 1280 > l + w THEN round_even(ax1 * 1280 - w, 0) ELSE l END))::INT AS x, w, 720 AS h FROM x""",
    "median_box": f"WITH {BOXES}, m AS (SELECT label, median(ay0) AS my FROM b GROUP BY 1) SELECT label, round(median(ax0), 9) AS x0, round(median(ay0), 9) AS y0, round(median(ax1), 9) AS x1, round(median(ay1), 9) AS y1 FROM b JOIN m USING (label) WHERE abs(ay0 - my) <= 0.06 GROUP BY label",
    "ncc_similarity": f"""WITH {CELLS}, ref AS (SELECT label, pos, arg_min(x, vec_id) AS r FROM cells GROUP BY 1, 2), s AS (SELECT vec_id, corr(x, r) AS c, avg(abs(x - r)) AS m FROM cells JOIN ref USING (label, pos) GROUP BY vec_id)
      SELECT vec_id, round(c, 6) AS ncc, round(m, 6) AS mad FROM s""",
    "median_reference": f"WITH {CELLS} SELECT label, pos::BIGINT AS at, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std FROM cells GROUP BY label, pos",
    "static_mask": f"""WITH {CELLS}, m AS (SELECT label, pos, median(x) AS med FROM cells GROUP BY 1, 2), o AS (SELECT label, pos, row_number() OVER (PARTITION BY label, pos ORDER BY abs(x - med) DESC) AS r, abs(x - med) AS d FROM cells JOIN m USING (label, pos))
      SELECT label, round(count(*) FILTER (d < 0.3) / count(DISTINCT pos), 6) AS steady FROM (SELECT DISTINCT label, pos, CASE WHEN r = 2 THEN d END AS d FROM o) GROUP BY label""",
    "hist_peak_share": f"WITH {CELLS}, n AS (SELECT label, floor(x / 0.05::DOUBLE)::BIGINT AS bin, count(*) AS n FROM cells GROUP BY 1, 2) SELECT label, bin, n FROM (SELECT *, max(n) OVER (PARTITION BY label) AS top FROM n) WHERE n >= top * 0.25",
    "better_half": f"WITH {CELLS}, r AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r, count(*) OVER (PARTITION BY vec_id) AS n FROM cells) SELECT vec_id, round(avg(x), 9) AS top FROM r WHERE r <= greatest(1, n // 2) GROUP BY vec_id",
    "ctc_collapse": f"WITH {CELLS}, b AS (SELECT vec_id, pos, ((floor(x * 10)::INT % 4) + 4) % 4 AS k FROM cells), l AS (SELECT *, lag(k, 1, -1) OVER (PARTITION BY vec_id ORDER BY pos) AS p FROM b) SELECT vec_id, coalesce(string_agg(k::VARCHAR, '' ORDER BY pos) FILTER (k <> p AND k <> 0), '') AS text FROM l GROUP BY vec_id",
    "ink_runs": f"WITH {CELLS}, k AS (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS g FROM cells WHERE x >= 0.1) SELECT vec_id, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last FROM k GROUP BY vec_id, g",
    "batch_rows": f"WITH {EV} SELECT user_id, (i // 8)::BIGINT AS batch, count(*) AS n, min(event_id) AS first_id FROM ev GROUP BY 1, 2",
}

QUERIES = {
    f.__name__: f
    for f in (
        largest_deficit, running_score, score_fold_exact, asof_backward, asof_forward, asof_tolerance, median_lag, chain_lookup, greedy_match, match_summary, unmatched_both, fuzzy_code_join, source_fallback, edit_carryover,
        prefix_cutlist, latest_with_count, oldest_until_room, eta, retention_sweep, top3_scorers, sides_first_seen, mode_label, ordered_distinct_concat, read_rates, confidence_penalty, quality_ratios, rate_limit_window,
        budget_gate, grid_chunks, settled_files, box_iou, crop_rule, median_box, ncc_similarity, median_reference, static_mask, hist_peak_share, better_half, ctc_collapse, ink_runs, batch_rows,
    )
}
