"""Queries of landed documents: two shapes of one feed as one table, and what becomes of files that can't be used; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import landed
from tidemark.sources.files import table
from tidemark.sources.scratch import Scratch

KEEP = {"game": ("string", ["$.game", "$.header.id"])}
LISTS = ["$.plays", "$.live.events"]
FIELDS = {
    "play": ("bigint", ["$.id", "$.event.number"]), "clock": ("double", ["$.clock", "$.time.left"]), "team": ("string", ["$.team", "$.side"]),
    "points": ("int", ["$.score.points", "$.pts"]), "note": ("string", ["$.note"]),
}


def _documents(spark, sf_dir):
    """A customer's orders as a document: of one shape for even keys, of another, with texts for numbers, for odd ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7200 / 10).alias("clock"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 4).cast("int").alias("p"))
    one = F.struct(F.col("k").alias("id"), "clock", F.col("s").alias("team"), F.struct(F.col("p").alias("points")).alias("score"), F.when(F.col("p") == 3, "three").alias("note"))
    two = F.struct(F.struct(F.col("k").cast("string").alias("number")).alias("event"), F.struct(F.col("clock").cast("string").alias("left")).alias("time"), F.col("s").alias("side"), F.col("p").cast("string").alias("pts"))
    docs = o.groupBy("c").agg(F.sort_array(F.collect_list(one)).alias("one"), F.sort_array(F.collect_list(two)).alias("two"))
    first = F.to_json(F.struct(F.col("c").cast("string").alias("game"), F.col("one").alias("plays")))
    second = F.to_json(F.struct(F.struct(F.col("c").alias("id")).alias("header"), F.struct(F.col("two").alias("events")).alias("live")))
    return docs.select("c", F.when(F.col("c") % 2 == 0, first).otherwise(second).alias("raw"))


def variant_events(spark, sf_dir):
    docs = landed.judged(_documents(spark, sf_dir), ["$.plays", "$.live.events"])
    return landed.listed(docs.select("doc"), KEEP, LISTS, FIELDS).drop("at")


def landed_kinds(spark, sf_dir):
    """A file for each nation; some break off, refuse, or are no JSON."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    good = F.to_json(F.struct(F.col("c_nationkey").alias("id"), "n"))
    how = F.col("c_nationkey") % 6
    text = F.when(how == 1, F.substring(good, 1, 9)).when(how == 2, F.lit('{"error": "no such game"}')).when(how == 3, F.lit("{n: }")).when(how == 4, F.lit('{"other": 1}')).when(how == 5, F.lit(" ")).otherwise(good)
    scratch = Scratch(spark, "landed")
    c.select(F.col("c_nationkey").alias("nation"), text.alias("value")).repartition("nation").write.partitionBy("nation").text(scratch.path("files"))
    rows = landed.judged(landed.read(spark, scratch.path("files")), ["$.n"])
    return rows.select(F.regexp_extract("path", "nation=([0-9]+)", 1).cast("int").alias("nation"), "kind", F.try_variant_get("doc", "$.n", "bigint").alias("n"))


SQL = {
    "variant_events": """SELECT o_custkey::VARCHAR AS game, o_orderkey AS play, o_orderkey % 7200 / 10.0::DOUBLE AS clock, o_orderstatus AS team, (o_orderkey % 4)::INT AS points,
      CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 4 = 3 THEN 'three' END AS note FROM orders""",
    "landed_kinds": """SELECT c_nationkey AS nation, (['ok', 'retry', 'refused', 'broken', 'refused', 'retry'])[c_nationkey % 6 + 1] AS kind, CASE WHEN c_nationkey % 6 = 0 THEN count(*) END AS n FROM customer GROUP BY c_nationkey""",
}
QUERIES = {f.__name__: f for f in (variant_events, landed_kinds)}
