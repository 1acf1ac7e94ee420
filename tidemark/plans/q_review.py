"""Queries of the review operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import intervals, review, sequence
from tidemark.plans import rules
from tidemark.plans.q_intervals import SPANS, _spans, merged_sql
from tidemark.plans.q_sequence import DAY, EV, ISLAND, KEY, ORDER, events
from tidemark.sources.files import table


def game_time_lookup(spark, sf_dir):
    """First time at which a user's purchases add up to a multiple of five."""
    ev = events(spark, sf_dir).withColumn("n", F.sum((F.col("event_type") == "purchase").cast("long")).over(sequence.over(KEY, ORDER)))
    targets = ev.select("user_id").distinct().withColumn("target", F.explode(F.array(*(F.lit(x).cast("long") for x in (5, 10, 15, 20)))))
    return review.first_at(ev.select("user_id", "t", "n"), targets, KEY, "t", "n", "target").select("user_id", "target", "found_t")


def stopped_since(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "user_id", "t", "event_type")
    return review.unchanged_since(ev, KEY, "t", "event_type", DAY, 3 * DAY).select("event_id", "unchanged")


def last_clock_stop(spark, sf_dir):
    ev = events(spark, sf_dir)
    held = sequence.runs(ev, KEY, ORDER, "event_type").filter("n >= 2")
    return review.last_onset(ev.select("event_id", "user_id", "t"), held, KEY, "t", 2 * DAY).select("event_id", "onset")


def play_start(spark, sf_dir):
    """Purchases with the last click before them within a day, else half a day before."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "t", "event_type")
    clicks = ev.filter("event_type = 'click'").select("user_id", F.col("t").alias("at"))
    return rules.last_sign(ev.filter("event_type = 'purchase'"), clicks, KEY, DAY, DAY / 2, "sign", "before").select("event_id", "start", "cause")


def score_kinds(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") > 25).alias("stopped"), (F.col("l_discount") * 100).alias("held"))
    seen = F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit("free_throw"), F.lit("two_point")))
    kinds = [rules.kind(s, F.col("l_linenumber"), F.col("stopped"), F.col("held"), seen).alias(s) for s in ("basketball", "football", "hockey", "baseball")]
    return line.select("l_orderkey", "l_linenumber", "l_partkey", *kinds)


def piecewise_value(spark, sf_dir):
    ev = events(spark, sf_dir)
    frames = ev.filter("event_type = 'purchase'").select("user_id", "t", "value")
    return review.on_key_frames(ev.select("event_id", "user_id", "t"), frames, KEY, "t", "value").select("event_id", F.round("on_track", 6).alias("on_track"))


def side_swap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 90).alias("away"), (F.col("o_custkey") % 90).alias("home"))
    turned = F.col("o_orderkey") % 3 == 0
    read = o.withColumn("read_away", F.when(turned, F.col("home")).otherwise(F.col("away"))).withColumn("read_home", F.when(turned, F.col("away")).otherwise(F.col("home")))
    marked = read.withColumn("reversed", review.sides_reversed(read))
    return review.swapped(marked, F.col("reversed"), [("read_away", "read_home")]).select("o_orderkey", "reversed", "read_away", "read_home")


def patch_merge(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    samples = line.select("l_orderkey", "l_linenumber", F.col("p").cast("string").alias("text"), (F.col("q") / 50).cast("float").alias("conf"))
    patch = line.filter(F.col("p") % 2 == 0).select("l_orderkey", "l_linenumber", F.when(F.col("p") % 4 == 0, F.col("p").cast("string")).otherwise(F.col("q").cast("int").cast("string")).alias("text"))
    return review.patched(samples, patch, ["l_orderkey", "l_linenumber"], parse.score(F.col("_new")).isNotNull()).select("l_orderkey", "l_linenumber", "text", F.round(F.col("conf").cast("double"), 6).alias("conf"))


def uncertain_pick(spark, sf_dir):
    ev = events(spark, sf_dir).select("user_id", "i", "event_id", (F.col("value") < 8).alias("unsure"), "event_type")
    w = sequence.over(KEY, ORDER)
    buys = ev.filter("event_type = 'purchase'").withColumn("i_prev", F.lag("i").over(w)).select("user_id", "i_prev", "i").filter("i_prev IS NOT NULL")
    return review.worth_rereading(ev, buys, KEY, "i", 5, 0.25).select("event_id", "rank")


def source_time(spark, sf_dir):
    cuts = intervals.merge(_spans(spark, sf_dir)[0], KEY)
    asked = cuts.select("user_id").distinct().withColumn("offset", F.explode(F.array(*(F.lit(float(x)) for x in (0.0, 30000.0, 200000.0, 900000.0)))))
    return review.source_time(cuts, asked, KEY).select("user_id", "offset", F.round("source_t", 3).alias("source_t"))


def template_match(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("px", F.transform("embedding", lambda x: x.cast("double")))
    t = e.select(F.col("label").alias("shape"), F.col("vec_id").alias("template_id"), F.col("vec_id").alias("made_at"), F.col("px").alias("ref"))
    dot = F.aggregate(F.zip_with("px", "ref", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return review.first_template(e.withColumn("shape", F.col("label")), t, ["label"], F.round(dot, 6) >= 0.1).select("label", "template_id", "n_alike", "n")


def nearest_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("frame", F.floor(F.col("vec_id") / 10)).select("frame", F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("embedding")[2] > 0).alias("number"))
    return review.nearest_box(e.filter("number"), e.filter("NOT number"), ["frame"]).select("frame", "id", "label_id", F.round("distance", 9).alias("distance"))


def box_clusters(spark, sf_dir):
    from tidemark.plans.q_joins import _boxes

    b = _boxes(spark, sf_dir).select("label", F.col("vec_id").alias("id"), "a.*", (F.col("vec_id") % 3 == 0).alias("split"))
    return review.cluster_boxes(b, ["label"], 0.3)


def clip_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("game_id"), F.col("o_orderkey").alias("clip_order"), F.col("o_orderstatus").alias("team"), (F.col("o_orderkey") % 2 == 0).alias("warned"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"), F.lit(False).alias("edited"))
    return review.kept_clips(o, team="O", warned=True, low=0.7).select("game_id", "clip_order", "confidence", "place")


def caption_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderkey") % 25
    title = review.suggested_title(F.col("o_orderpriority"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).otherwise(""), d, F.col("o_custkey") % 3 == 0)
    tags = review.distinct_tags(F.array(F.lit("#a"), parse.hashtag(F.col("o_orderstatus")), F.lit("#A"), F.when(d >= 10, "#comeback").otherwise("")))
    return o.select("o_orderkey", title.alias("title"), tags.alias("tags"))


SQL = {
    "game_time_lookup": f"""WITH {EV}, n AS (SELECT user_id, t, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY i) AS n FROM ev), g AS (SELECT DISTINCT user_id, unnest([5, 10, 15, 20]::BIGINT[]) AS target FROM ev)
      SELECT g.user_id, target, min(t) AS found_t FROM g LEFT JOIN n ON n.user_id = g.user_id AND n.n >= target GROUP BY 1, 2""",
    "stopped_since": f"WITH {EV}, a AS (SELECT event_id, user_id, t, t - {DAY} AS u, event_type FROM ev) SELECT a.event_id, coalesce(b.event_type = a.event_type AND a.t - b.t <= {3 * DAY}, false) AS unchanged FROM a ASOF LEFT JOIN ev b ON a.user_id = b.user_id AND a.u >= b.t",
    "last_clock_stop": f"""WITH {EV}, r AS ({ISLAND.format(x='event_type', src='ev')}), h AS (SELECT user_id, min(t) AS o FROM r GROUP BY user_id, run HAVING count(*) >= 2)
      SELECT e.event_id, CASE WHEN e.t - h.o <= {2 * DAY} THEN h.o END AS onset FROM ev e ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.t >= h.o""",
    "play_start": f"""WITH {EV}, s AS (SELECT user_id, t FROM ev WHERE event_type = 'click')
      SELECT e.event_id, CASE WHEN e.t - s.t <= {DAY} THEN s.t ELSE e.t - {DAY / 2} END AS start, CASE WHEN e.t - s.t <= {DAY} THEN 'sign' ELSE 'before' END AS cause
      FROM (SELECT * FROM ev WHERE event_type = 'purchase') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.t > s.t""",
    "score_kinds": """SELECT l_orderkey, l_linenumber, l_partkey, 'goal' AS hockey, 'run' AS baseball,
      CASE WHEN l_partkey % 3 = 0 THEN 'field_goal' WHEN l_linenumber = 1 OR (l_quantity > 25 AND l_discount * 100 >= 8) THEN 'free_throws' ELSE 'field_goal' END AS basketball,
      CASE WHEN l_linenumber >= 6 THEN 'touchdown' WHEN l_linenumber = 3 THEN 'field_goal' WHEN l_linenumber = 1 THEN 'extra_point'
           WHEN l_linenumber = 2 THEN CASE WHEN l_partkey % 3 = 0 OR l_quantity > 25 THEN 'two_point' ELSE 'safety' END ELSE 'score' END AS football FROM lineitem""",
    "piecewise_value": f"""WITH {EV}, f AS (SELECT user_id, t, value, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t2, lead(value) OVER (PARTITION BY user_id ORDER BY t) AS v2, first_value(value) OVER (PARTITION BY user_id ORDER BY t) AS v0 FROM ev WHERE event_type = 'purchase')
      SELECT e.event_id, round(coalesce(f.value + (v2 - f.value) * ((e.t - f.t) / (t2 - f.t)), f.value, (SELECT any_value(v0) FROM f g WHERE g.user_id = e.user_id)), 6) AS on_track FROM ev e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.t >= f.t""",
    "side_swap": "SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 90 <> o_custkey % 90 AS reversed, o_orderkey % 90 AS read_away, o_custkey % 90 AS read_home FROM orders",
    "patch_merge": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT *, (q / 50)::FLOAT AS conf, CASE WHEN p % 2 = 0 THEN CASE WHEN p % 4 = 0 THEN p ELSE q::BIGINT END END AS new FROM l),
      k AS (SELECT *, coalesce(new <= 250 AND length(new::VARCHAR) <= 3 AND (new <> p OR conf < 0.9::FLOAT), false) AS take FROM s)
      SELECT l_orderkey, l_linenumber, CASE WHEN take THEN new ELSE p END::VARCHAR AS text, round(CASE WHEN take THEN 0.95::FLOAT ELSE conf END::DOUBLE, 6) AS conf FROM k""",
    "uncertain_pick": f"""WITH {EV}, b AS (SELECT user_id, lag(i) OVER (PARTITION BY user_id ORDER BY i) AS p, i FROM ev WHERE event_type = 'purchase'), s AS (SELECT *, value < 8 AS u, avg((value < 8)::INT) OVER (PARTITION BY user_id) AS rate FROM ev),
      k AS (SELECT *, EXISTS (SELECT 1 FROM b WHERE b.user_id = s.user_id AND b.i - b.p >= 3 AND s.i > b.p AND s.i < b.i) AS near FROM s WHERE u AND rate <= 0.25)
      SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN near THEN 0 ELSE 1 END, i)::INT AS rank FROM k) WHERE rank <= 5""",
    "source_time": f"""WITH {SPANS}, m AS ({merged_sql('spans')}), p AS (SELECT *, sum(b - a) OVER (PARTITION BY user_id ORDER BY a) - (b - a) AS o FROM m), q AS (SELECT DISTINCT user_id, unnest([0.0, 30000.0, 200000.0, 900000.0]::DOUBLE[]) AS off_ FROM m)
      SELECT q.user_id, off_ AS "offset", round(least(a + (off_ - o), b), 3) AS source_t FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.off_ >= p.o""",
    "template_match": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS px FROM embeddings), p AS (SELECT e.label, t.vec_id AS template_id, (round(list_sum(list_transform(range(1, len(e.px) + 1), lambda i: e.px[i] * t.px[i])), 6) >= 0.1)::INT AS a FROM e JOIN e t ON e.label = t.label),
      g AS (SELECT label, template_id, sum(a)::BIGINT AS n_alike, count(*) AS n FROM p GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY template_id DESC) AS r FROM g WHERE n_alike >= greatest(2, ceil(n * 0.2)))
      SELECT label, template_id, n_alike, n FROM k WHERE r = 1""",
    "nearest_label": """WITH e AS (SELECT vec_id // 10 AS frame, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3] > 0 AS num FROM embeddings), p AS (SELECT a.frame, a.id, b.id AS label_id, abs(a.x - b.x) + 2 * abs(a.y - b.y) AS d FROM e a JOIN e b ON a.frame = b.frame AND a.num AND NOT b.num)
      SELECT frame, id, label_id, round(d, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY frame, id ORDER BY d, label_id) AS r FROM p) WHERE r = 1""",
    "box_clusters": """WITH RECURSIVE b AS (SELECT label, vec_id AS id, vec_id % 3 = 0 AS split, abs(embedding[1]::DOUBLE) AS x0, abs(embedding[2]::DOUBLE) AS y0, abs(embedding[1]::DOUBLE) + abs(embedding[3]::DOUBLE) + 0.2::DOUBLE AS x1, abs(embedding[2]::DOUBLE) + abs(embedding[4]::DOUBLE) + 0.1::DOUBLE AS y1 FROM embeddings),
      n AS (SELECT label, id, {'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} AS b, row_number() OVER (PARTITION BY label ORDER BY split, id) AS k FROM b),
      f AS (SELECT DISTINCT label, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS cluster, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS heads FROM n
        UNION ALL SELECT label, k, id, coalesce(hit, len(heads)), CASE WHEN hit IS NULL THEN list_append(heads, b) ELSE heads END FROM (
          SELECT n.label, n.k, n.id, n.b, f.heads, (SELECT min(j) FROM (SELECT unnest(range(0, len(f.heads))) AS j, unnest(f.heads) AS h) WHERE
              greatest(least(n.b.x1, h.x1) - greatest(n.b.x0, h.x0), 0) * greatest(least(n.b.y1, h.y1) - greatest(n.b.y0, h.y0), 0)
              / greatest((n.b.x1 - n.b.x0) * (n.b.y1 - n.b.y0) + (h.x1 - h.x0) * (h.y1 - h.y0) - greatest(least(n.b.x1, h.x1) - greatest(n.b.x0, h.x0), 0) * greatest(least(n.b.y1, h.y1) - greatest(n.b.y0, h.y0), 0), 1e-12) >= 0.3) AS hit
          FROM f JOIN n ON n.label = f.label AND n.k = f.k + 1))
      SELECT label, id, cluster FROM f WHERE k > 0""",
    "clip_filter": "SELECT o_custkey::VARCHAR AS game_id, o_orderkey AS clip_order, o_orderkey % 100 / 100.0::DOUBLE AS confidence, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 100, o_orderkey)::INT AS place FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_orderkey % 100 / 100.0::DOUBLE < 0.7",
    "caption_text": """WITH o AS (SELECT *, o_orderkey % 25 AS d, CASE WHEN o_custkey % 2 = 0 THEN ' vs ' || o_orderstatus ELSE '' END AS v FROM orders)
      SELECT o_orderkey, CASE WHEN d >= 10 AND o_custkey % 3 = 0 THEN o_orderpriority || ' ' || d || '-point comeback' || v WHEN d >= 10 THEN o_orderpriority || ' run from ' || d || ' down' || v ELSE 'Every ' || o_orderpriority || ' bucket' || v END AS title,
        '#a #' || o_orderstatus || CASE WHEN d >= 10 THEN ' #comeback' ELSE '' END AS tags FROM o""",
}

QUERIES = {
    f.__name__: f
    for f in (game_time_lookup, stopped_since, last_clock_stop, play_start, score_kinds, piecewise_value, side_swap, patch_merge, uncertain_pick, source_time, template_match, nearest_label, box_clusters, clip_filter, caption_text)
}
