"""The rules of all sports as one small table, joined to rows of many sports at once.

``plans.timeline`` and ``plans.clips`` take one sport; these take a column ``sport``. The table has
a row for each sport, so it is always small enough to be sent to every task. Rows of an unknown
sport are kept: what has no rule is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.plans.clips import PLAY_STARTS
from tidemark.plans.timeline import CLOCK_CONF, KEY, SCORE_CONF, SPORTS

#: Fields that have a column of their own; all others are kept as texts.
OWN = ("away_score", "home_score", "period", "clock", "shot_clock")
RULES = "sport string, regulation int, period_seconds double, overtime_seconds double, shot_max double, most_points int, before double, after double, min_clip double, max_clip double, reader string, colon_led boolean, clocked boolean, sign string, cause string, reach double, back double, otherwise string"


def rule_table(spark: SparkSession) -> DataFrame:
    """A row for each sport: how its display is read, how long its periods and clips are, which sign starts a play."""
    rows = []
    for s in SPORTS.values():
        cause, reach, back, otherwise = PLAY_STARTS.get(s.name, (None, None, None, None))
        sign = None if cause is None else "count" if s.name == "baseball" else "clock"
        rows.append((s.name, s.regulation, s.period_seconds, s.overtime_seconds, s.shot_max, s.most_points, *s.rolls, s.min_clip, s.max_clip, s.reader, s.colon_led, s.clocked, sign, cause, reach, back, otherwise))
    return spark.createDataFrame(rows, RULES)


def _ruled(df: DataFrame) -> DataFrame:
    rules = rule_table(df.sparkSession)
    return df.join(F.broadcast(rules.select(F.col("sport"), F.struct(*[c for c in rules.columns if c != "sport"]).alias("rule"))), "sport", "left")


def typed(samples: DataFrame) -> DataFrame:
    """Readings of samples (sport, game_id, i, t, visible, fields) by the rules of their sport.

    period, clock, shot_clock, away_score, home_score, game_seconds, and ``texts`` of all other fields.
    """
    rows = _ruled(samples)
    field = lambda f: F.coalesce(F.col("fields")[f]["text"], F.lit(""))
    sure = lambda f: F.coalesce(F.col("fields")[f]["conf"], F.lit(0).cast("float"))
    of = lambda f, least, value: parse.trusted(field(f), sure(f), F.col("visible"), least, value)
    clock = F.when(F.col("rule.clocked"), of("clock", CLOCK_CONF, parse.clock_by(F.col("rule.colon_led"), field("clock"))))
    shot = of("shot_clock", CLOCK_CONF, parse.shot_clock(field("shot_clock")))
    others = F.map_filter(F.col("fields"), lambda k, v: ~k.isin(*OWN) & F.col("visible") & (v["conf"] >= F.lit(CLOCK_CONF).cast("float")) & (F.trim(v["text"]) != ""))
    out = rows.select(
        *KEY, "sport", "i", "t",
        of("period", CLOCK_CONF, parse.period_by(F.col("rule.reader"), field("period"), F.col("rule.regulation"))).alias("period"),
        F.when(clock <= F.col("rule.period_seconds") + 0.5, clock).alias("clock"), F.when(shot <= F.col("rule.shot_max") + 0.5, shot).alias("shot_clock"),
        of("away_score", SCORE_CONF, parse.score(field("away_score"))).alias("away_score"), of("home_score", SCORE_CONF, parse.score(field("home_score"))).alias("home_score"),
        F.transform_values(others, lambda k, v: F.trim(v["text"])).alias("texts"), "rule",
    )
    over = F.greatest(F.col("period") - 1 - F.col("rule.regulation"), F.lit(0)) * F.col("rule.overtime_seconds")
    length = F.when(F.col("period") <= F.col("rule.regulation"), F.col("rule.period_seconds")).otherwise(F.col("rule.overtime_seconds"))
    played = F.least(F.col("period") - 1, F.col("rule.regulation")) * F.col("rule.period_seconds") + over + F.greatest(F.lit(0.0), length - F.col("clock"))
    return out.withColumn("game_seconds", F.when(F.col("rule.clocked"), F.when(F.col("clock").isNotNull(), played)).otherwise(F.col("period").cast("double"))).drop("rule")


def play_starts(changes: DataFrame, signs: DataFrame) -> DataFrame:
    """``changes`` (sport, game_id, t) with ``start`` and ``cause``: the last sign of the sport's kind before, if near enough, else a fixed time before.

    signs: game_id, at, sign ('clock', 'count'). One window over both tables, whatever the sports.
    """
    asked = changes.select(*KEY, F.col("t").alias("_at"), F.lit(0).alias("_sign"), F.struct(*[c for c in changes.columns if c not in KEY]).alias("_c"))
    both = asked.unionByName(signs.select(*KEY, F.col("at").cast("double").alias("_at"), F.lit(1).alias("_sign"), F.col("sign").alias("_kind")), allowMissingColumns=True)
    w = Window.partitionBy(*KEY).orderBy("_at", "_sign").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {k: F.last(F.when(F.col("_kind") == k, F.col("_at")), ignorenulls=True).over(w) for k in ("clock", "count")}
    seen = both.withColumns({f"_{k}": c for k, c in last.items()}).filter("_sign = 0").select(*KEY, "_c.*", "_clock", "_count")
    rows = _ruled(seen).withColumn("_last", F.when(F.col("rule.sign") == "count", F.col("_count")).otherwise(F.col("_clock")))
    near = F.coalesce(F.col("t") - F.col("_last") <= F.col("rule.reach"), F.lit(False))
    start, cause = F.when(near, F.col("_last")).otherwise(F.col("t") - F.col("rule.back")), F.when(near, F.col("rule.cause")).otherwise(F.col("rule.otherwise"))
    return rows.select(*changes.columns, start.alias("start"), cause.alias("cause"), (start - F.col("rule.before")).alias("a"), (F.col("t") + F.col("rule.after")).alias("b"))
