"""Values of the parsers, and degenerate texts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse

CASES = [
    (parse.clock, [("3:07", 187.0), ("0:59", 59.0), ("8.6", 8.6), ("959", 599.0), ("1130", 690.0), ("2:60", None), ("21:30", None), ("44", None), (" 6 : 40 ", 400.0), ("", None), (None, None)]),
    (parse.score, [("0", 0), ("118", 118), ("999", None), ("1000", None), ("7O", None), (" 33 ", 33), ("", None), (None, None)]),
    (parse.shot_clock, [("14", 14.0), ("77", None), ("0.9", 0.9), ("240", None)]),
    (parse.period, [("4TH", 4), ("OT", 5), ("FINAL", None), ("Q2", 2), ("3rd qtr", 3), ("", None), (None, None)]),
    (parse.iso_clock, [("PT03M05.50S", 185.5), ("0:31", 31.0), ("7.25", 7.25), ("soon", None), (None, None)]),
    (parse.inning, [("TOP 1", 1), ("▼2", 4), ("END 9", 18), ("77", None)]),
    (parse.initial_name, [("Karl-Anthony Towns", "K. Towns"), ("Nene", "Nene")]),
    (parse.digits_fixed, [("1O:47", "10:47"), ("OFF", "OFF"), ("l2", "12")]),
]


@pytest.mark.parametrize("function,cases", CASES, ids=[c[0].__name__ for c in CASES])
def test_values(spark, function, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r.v for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [e for _, e in cases]


def test_elapsed(spark):
    one = lambda p, c, *s: spark.range(1).select(parse.elapsed(F.lit(p), F.lit(c), *s).alias("v")).first().v
    assert one(1, 0.0, 4, 900.0, 600.0) == one(2, 900.0, 4, 900.0, 600.0) == 900
    assert one(4, 300.0, 3, 1200.0, 300.0) == 3600


def test_fused_line(spark):
    row = spark.createDataFrame([("2ND3:0020",)], "t string").select(parse.fused_parts(F.col("t")).alias("p")).first().p
    assert (row.period, row.clock, row.shot) == ("2ND", "3:00", "20")


def test_same_code(spark):
    df = spark.createDataFrame([("NY", "NYK", True), ("SA", "SAS", True), ("BOS", "BKN", False), ("", "X", False)], "a string, b string, e boolean")
    assert df.filter(parse.same_code(F.col("a"), F.col("b")) != F.col("e")).count() == 0
