"""Queries of the text parsers over short strings made from ``lineitem`` and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.plans.timeline import SPORTS, title
from tidemark.sources import feeds
from tidemark.sources.files import micros, table

#: The strings of a row: quantities and line numbers written as scores, clocks and periods.
READS = """reads AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity::BIGINT AS q, l_partkey % 100 AS s,
    CASE l_linenumber WHEN 1 THEN (l_quantity::BIGINT)::VARCHAR || ':' || lpad((l_partkey % 100)::VARCHAR, 2, '0') WHEN 2 THEN (l_quantity::BIGINT)::VARCHAR || '.' || (l_partkey % 10)::VARCHAR
      WHEN 3 THEN (l_quantity::BIGINT * 37)::VARCHAR WHEN 4 THEN ' ' || (l_quantity::BIGINT)::VARCHAR || ' ' WHEN 5 THEN 'x' || (l_quantity::BIGINT)::VARCHAR ELSE (l_partkey)::VARCHAR END AS text
  FROM lineitem)"""


def reads(spark, sf_dir):
    q, s = F.col("l_quantity").cast("long"), F.col("l_partkey") % 100
    text = (
        F.when(F.col("l_linenumber") == 1, F.concat(q.cast("string"), F.lit(":"), F.lpad(s.cast("string"), 2, "0")))
        .when(F.col("l_linenumber") == 2, F.concat(q.cast("string"), F.lit("."), (F.col("l_partkey") % 10).cast("string")))
        .when(F.col("l_linenumber") == 3, (q * 37).cast("string"))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit(" "), q.cast("string"), F.lit(" ")))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("x"), q.cast("string")))
        .otherwise(F.col("l_partkey").cast("string"))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", q.alias("q"), s.alias("s"), text.alias("text"))


def parse_score(spark, sf_dir):
    return reads(spark, sf_dir).select("l_orderkey", "text", parse.score(F.col("text")).alias("score"))


def parse_clock(spark, sf_dir):
    return reads(spark, sf_dir).select("l_orderkey", "text", parse.clock(F.col("text")).alias("clock"))


def parse_shot_clock(spark, sf_dir):
    return reads(spark, sf_dir).select("l_orderkey", "text", parse.shot_clock(F.col("text")).alias("shot"))


def _period_text(q):
    return F.get(F.array(*map(F.lit, ("1ST", "Q2", "3RO", "15T", "2OT", "HALF", "IST", "4th qtr", "OT", "F"))), (q % 10).cast("int"))


def parse_period(spark, sf_dir):
    r = reads(spark, sf_dir).withColumn("label", _period_text(F.col("q")))
    return r.select("l_orderkey", "label", parse.period(F.col("label")).alias("period"), parse.overtime_period(F.col("label")).alias("period_of_three"))


def parse_inning(spark, sf_dir):
    mark = F.get(F.array(*map(F.lit, ("TOP ", "BOT ", "MID ", "▲", "▼", "", "END "))), (F.col("l_partkey") % 7).cast("int"))
    r = reads(spark, sf_dir).withColumn("label", F.concat(mark, F.col("q").cast("string")))
    return r.select("l_orderkey", "label", parse.inning(F.col("label")).alias("half"))


def parse_iso_clock(spark, sf_dir):
    text = F.when(F.col("l_linenumber") % 2 == 0, F.format_string("PT%dM%d.00S", F.col("q"), F.col("s"))).otherwise(F.col("text"))
    r = reads(spark, sf_dir).withColumn("iso", text)
    return r.select("l_orderkey", "iso", parse.iso_clock(F.col("iso")).alias("clock"))


def parse_fields(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ("clock", "home_score", "shot_clock", "period"))), (F.col("l_partkey") % 4).cast("int"))
    r = reads(spark, sf_dir).withColumn("name", name).withColumn("conf", (F.col("s") / 100).cast("float")).withColumn("visible", F.col("l_partkey") % 5 > 0)
    value = parse.trusted(F.col("text"), F.col("conf"), F.col("visible"), 0.45, parse.field(F.col("name"), F.col("text")))
    return r.select("l_orderkey", "name", "text", value.alias("value"))


def elapsed_time(spark, sf_dir):
    r = reads(spark, sf_dir).withColumn("period", (F.col("q") % 7 + 1).cast("int"))
    cols = [parse.elapsed(F.col("period"), (F.col("s") * 7).cast("double"), x.regulation, x.period_seconds, x.overtime_seconds).alias(n) for n, x in SPORTS.items()]
    return r.select("l_orderkey", "period", "s", *cols, parse.period_label(F.col("period"), 4).alias("label"))


def labels_text(spark, sf_dir):
    r = reads(spark, sf_dir)
    return r.select("l_orderkey", "q", "s", parse.clock_label(F.col("q") * 13.5).alias("clock"), parse.time_label(F.col("l_partkey") * 37).alias("at"), parse.roman(F.col("s")).alias("roman"))


def season_of(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.season(F.col("o_orderdate")).alias("season"))


def initial_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", parse.initial_name(F.col("p_name")).alias("short"), parse.hashtag(F.col("p_name")).alias("tag"), parse.file_name(F.col("p_type")).alias("file"))


def fused_split(spark, sf_dir):
    line = F.format_string("%s%d:%02d %d", _period_text(F.col("q")), F.col("q") % 13, F.col("s") % 60, F.col("q") % 25)
    r = reads(spark, sf_dir).withColumn("line", line).withColumn("parts", parse.fused_parts(F.col("line")))
    return r.select("l_orderkey", "line", "parts.clock", "parts.shot", parse.clock_inside(F.col("line")).alias("inside"))


def text_predicates(spark, sf_dir):
    r = reads(spark, sf_dir).withColumn("label", F.upper(_period_text(F.col("q"))))
    return r.select("l_orderkey", parse.is_clock(F.col("text")).alias("is_clock"), parse.is_label(F.col("label")).alias("is_label"))


def json_extract_props(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def defense_regex(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, " (Ann Lee steals)").when(F.col("turn") % 3 == 1, " Block").otherwise("")))
    d = feeds.described_defense(F.col("text"))
    return feeds.defensive_plays(c.withColumn("kind", F.lit("")), "text", "kind").select("conv_id", "turn", "defense", d["player"].alias("player"), d["kind"].alias("said"))


def title_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = title(F.col("o_orderpriority"), F.col("o_orderkey") % 4, (F.col("o_custkey") % 5 + 1).cast("int"), (F.col("o_orderkey") % 720).cast("double"), F.col("o_custkey") % 120, F.col("o_orderkey") % 120, SPORTS["basketball"])
    return o.select("o_orderkey", text.alias("title"))


def timestamps_text(spark, sf_dir):
    from tidemark.sources.files import chapter_text

    o = table(spark, sf_dir, "orders").withColumn("at", (micros(F.col("o_orderdate")) / 1e6) % 7200)
    return o.select("o_orderkey", F.concat_ws(" ", parse.time_label(F.col("at")), F.col("o_orderstatus")).alias("line"), chapter_text(F.col("at"), F.col("at") + F.col("o_orderkey") % 2, F.concat(F.lit("a=b;"), F.col("o_orderstatus"))).alias("chapter"))


PERIOD = "(['1ST', 'Q2', '3RO', '15T', '2OT', 'HALF', 'IST', '4th qtr', 'OT', 'F'])[(q % 10 + 1)::INT]"
PERIOD_VALUE = "CASE q % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 6 WHEN 6 THEN 1 WHEN 7 THEN 4 WHEN 8 THEN 5 END"
TENTHS = "CASE WHEN regexp_full_match(trim(text), '[0-9]{1,2}\\.[0-9]') THEN regexp_extract(trim(text), '^([0-9]+)', 1)::INT + regexp_extract(trim(text), '([0-9])$', 1)::INT / 10.0::DOUBLE END"
CLOCK = f"""coalesce({TENTHS}, CASE WHEN regexp_full_match(replace(trim(text), ' ', ''), '[0-9]{{1,2}}:[0-9]{{2}}|[0-9]{{3,4}}') AND right(replace(trim(text), ' ', ''), 2)::INT < 60
  AND regexp_extract(replace(trim(text), ' ', ''), '^([0-9]{{1,2}}):?[0-9]{{2}}$', 1)::INT <= 20
  THEN (regexp_extract(replace(trim(text), ' ', ''), '^([0-9]{{1,2}}):?[0-9]{{2}}$', 1)::INT * 60 + right(replace(trim(text), ' ', ''), 2)::INT)::DOUBLE END)"""
SHOT = f"coalesce({TENTHS}, CASE WHEN regexp_full_match(trim(text), '[0-9]{{1,2}}') AND trim(text)::INT <= 40 THEN trim(text)::DOUBLE END)"
SCORE = "CASE WHEN regexp_full_match(trim(text), '[0-9]{1,3}') AND trim(text)::INT <= 250 THEN trim(text)::INT END"


def _elapsed(name: str) -> str:
    x = SPORTS[name]
    return f"least(period - 1, {x.regulation}) * {x.period_seconds}::DOUBLE + greatest(period - 1 - {x.regulation}, 0) * {x.overtime_seconds}::DOUBLE + greatest(0, CASE WHEN period <= {x.regulation} THEN {x.period_seconds} ELSE {x.overtime_seconds} END - s * 7)::DOUBLE AS {name}"


SQL = {
    "parse_score": f"WITH {READS} SELECT l_orderkey, text, {SCORE} AS score FROM reads",
    "parse_clock": f"WITH {READS} SELECT l_orderkey, text, {CLOCK} AS clock FROM reads",
    "parse_shot_clock": f"WITH {READS} SELECT l_orderkey, text, {SHOT} AS shot FROM reads",
    "parse_period": f"WITH {READS} SELECT l_orderkey, {PERIOD} AS label, {PERIOD_VALUE} AS period, CASE q % 10 WHEN 4 THEN 5 WHEN 8 THEN 4 WHEN 7 THEN NULL ELSE {PERIOD_VALUE} END AS period_of_three FROM reads",
    "parse_inning": f"""WITH {READS}, l AS (SELECT *, (['TOP ', 'BOT ', 'MID ', '▲', '▼', '', 'END '])[(l_partkey % 7 + 1)::INT] AS mark FROM reads)
      SELECT l_orderkey, mark || q::VARCHAR AS label, CASE WHEN q BETWEEN 1 AND 30 THEN 2 * q - CASE WHEN mark IN ('TOP ', '▲', '') THEN 1 ELSE 0 END END::INT AS half FROM l""",
    "parse_iso_clock": f"""WITH {READS}, i AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN format('PT{{}}M{{}}.00S', q, s) ELSE text END AS iso FROM reads)
      SELECT l_orderkey, iso, CASE WHEN l_linenumber % 2 = 0 THEN (q * 60 + s)::DOUBLE WHEN contains(iso, ':') THEN (split_part(iso, ':', 1)::INT * 60 + split_part(iso, ':', 2)::INT)::DOUBLE ELSE try_cast(trim(iso) AS DOUBLE) END AS clock FROM i""",
    "parse_fields": f"""WITH {READS}, f AS (SELECT *, (['clock', 'home_score', 'shot_clock', 'period'])[(l_partkey % 4 + 1)::INT] AS name FROM reads)
      SELECT l_orderkey, name, text, CASE WHEN l_partkey % 5 > 0 AND text <> '' AND (s / 100)::FLOAT >= 0.45::FLOAT THEN CASE name WHEN 'clock' THEN {CLOCK} WHEN 'home_score' THEN ({SCORE})::DOUBLE WHEN 'shot_clock' THEN {SHOT}
        ELSE CASE WHEN regexp_full_match(regexp_replace(upper(text), '[^A-Z0-9]', '', 'g'), '[1-4]') THEN regexp_replace(upper(text), '[^A-Z0-9]', '', 'g')::DOUBLE END END END AS value FROM f""",
    "elapsed_time": f"WITH {READS}, p AS (SELECT *, (q % 7 + 1)::INT AS period FROM reads) SELECT l_orderkey, period, s, {', '.join(_elapsed(n) for n in SPORTS)}, CASE WHEN period <= 4 THEN 'Q' || period WHEN period = 5 THEN 'OT' ELSE (period - 4) || 'OT' END AS label FROM p",
    "labels_text": f"""WITH {READS}, c AS (SELECT *, q * 13.5::DOUBLE AS x, l_partkey * 37 AS y FROM reads)
      SELECT l_orderkey, q, s, CASE WHEN x >= 60 THEN floor(x / 60)::INT || ':' || lpad(floor(x - 60 * floor(x / 60))::INT::VARCHAR, 2, '0') ELSE format('{{:.1f}}', x) END AS clock,
        CASE WHEN y >= 3600 THEN (y // 3600) || ':' || lpad((y % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((y % 60)::VARCHAR, 2, '0') ELSE (y // 60) || ':' || lpad((y % 60)::VARCHAR, 2, '0') END AS at,
        CASE WHEN s BETWEEN 1 AND 89 THEN (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX'])[(s // 10 + 1)::INT] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[(s % 10 + 1)::INT] END AS roman FROM c""",
    "season_of": "SELECT o_orderkey, (year(o_orderdate) - CASE WHEN month(o_orderdate) <= 2 THEN 1 ELSE 0 END)::INT AS season FROM orders",
    "initial_names": """SELECT p_partkey, CASE WHEN contains(trim(p_name), ' ') THEN left(trim(p_name), 1) || '. ' || regexp_replace(trim(p_name), '^\\S+\\s+', '') ELSE trim(p_name) END AS short,
      '#' || regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') AS tag, left(trim(regexp_replace(p_type, '[^A-Za-z0-9 ._-]+', '', 'g')), 70) AS file FROM part""",
    "fused_split": f"""WITH {READS} SELECT l_orderkey, {PERIOD} || (q % 13) || ':' || lpad((s % 60)::VARCHAR, 2, '0') || ' ' || (q % 25) AS line,
      CASE WHEN q % 10 = 1 AND q % 13 < 10 THEN '2' || (q % 13) WHEN q % 10 = 2 AND q % 13 < 10 THEN '0' || (q % 13) ELSE (q % 13)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock, (q % 25)::VARCHAR AS shot,
      ((CASE WHEN q % 10 = 1 AND q % 13 < 10 THEN 20 ELSE 0 END + q % 13) * 60 + s % 60)::DOUBLE AS inside FROM reads""",
    "text_predicates": f"WITH {READS} SELECT l_orderkey, regexp_full_match(trim(text), '[0-9]{{1,2}}:[0-9]{{2}}|[0-9]{{1,2}}\\.[0-9]') AS is_clock, q % 10 = 5 AS is_label FROM reads",
    "json_extract_props": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "defense_regex": """WITH c AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' (Ann Lee steals)' WHEN 1 THEN ' Block' ELSE '' END AS text, turn % 3 AS m FROM conversations)
      SELECT conv_id, turn, lower(regexp_extract(upper(text), '\\b(STEAL|BLOCK)\\b', 1)) AS defense, CASE m WHEN 0 THEN 'A. Lee' END AS player, CASE m WHEN 0 THEN 'steal' END AS said
      FROM c WHERE regexp_matches(upper(text), '\\b(STEAL|BLOCK)\\b')""",
    "title_text": """WITH o AS (SELECT *, o_orderkey % 720 AS c, o_custkey % 5 + 1 AS p FROM orders)
      SELECT o_orderkey, concat_ws(' · ', concat_ws(' ', CASE WHEN p <= 4 THEN 'Q' || p ELSE 'OT' END, CASE WHEN c >= 60 THEN (c // 60) || ':' || lpad((c % 60)::VARCHAR, 2, '0') ELSE format('{:.1f}', c::DOUBLE) END),
        concat_ws(' ', o_orderpriority, CASE WHEN o_orderkey % 4 > 0 THEN '+' || (o_orderkey % 4) END), (o_custkey % 120) || '-' || (o_orderkey % 120)) AS title FROM o""",
    "timestamps_text": """WITH o AS (SELECT *, (epoch_us(o_orderdate) / 1000000) % 7200 AS at_ FROM orders), s AS (SELECT *, floor(at_)::BIGINT AS y FROM o)
      SELECT o_orderkey, CASE WHEN y >= 3600 THEN (y // 3600) || ':' || lpad((y % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((y % 60)::VARCHAR, 2, '0') ELSE (y // 60) || ':' || lpad((y % 60)::VARCHAR, 2, '0') END || ' ' || o_orderstatus AS line,
        CASE WHEN o_orderkey % 2 >= 1 THEN '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (at_ * 1000)::BIGINT || chr(10) || 'END=' || ((at_ + 1) * 1000)::BIGINT || chr(10) || 'title=a\\=b\\;' || o_orderstatus END AS chapter FROM s""",
}

QUERIES = {
    f.__name__: f
    for f in (
        parse_score, parse_clock, parse_shot_clock, parse_period, parse_inning, parse_iso_clock, parse_fields, elapsed_time, labels_text, season_of, initial_names, fused_split, text_predicates, json_extract_props,
        defense_regex, title_text, timestamps_text,
    )
}
