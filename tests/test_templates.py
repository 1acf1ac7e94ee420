"""The last template that fits, against all pairs: templates are asked in passes from the last one back."""

import random

from pyspark.sql import functions as F

from tidemark.operators import review

FRAMES, TEMPLATES = "g string, shape int, x double", "shape int, template_id long, made_at int, y double"


def _all_pairs(frames, templates, reach):
    """Every frame of an entity with every template of its shape."""
    per = {}
    for g, shape, x in frames:
        for t, k, at, y in ((t[0], *t[1:]) for t in templates):
            if t == shape:
                hit = per.setdefault(g, {}).setdefault((at, -k), [0, 0])
                hit[0] += abs(x - y) <= reach
                hit[1] += 1
    fits = {g: [(k, *v) for k, v in of.items() if v[0] >= max(2, -(-v[1] // 5))] for g, of in per.items()}
    return {(g, -max(v)[0][1], *max(v)[1:]) for g, v in fits.items() if v}


def test_first_template_in_passes(spark, monkeypatch):
    deal = random.Random(5)
    frames = [(g, deal.randint(0, 1), deal.random()) for g in "abcd" for _ in range(30)] + [(None, 0, deal.random()) for _ in range(9)] + [("z", 9, 0.5)]
    # few of the latest templates fit, none fits "e", whose shape is its own
    frames += [("e", 2, 5.0 + deal.random()) for _ in range(10)]
    templates = [(deal.randint(0, 2), k, k // 3, deal.random() + (2.0 if k > 40 else 0.0)) for k in range(150)] + [(0, 7, 2, 0.5), (0, 7, 2, 0.6)]
    asked = []
    monkeypatch.setattr(review, "FEW", 3)
    monkeypatch.setattr(review, "SENT", 40)
    monkeypatch.setattr(review.Scratch, "write", lambda self, df, name, write=review.Scratch.write: (asked.append(name), write(self, df, name))[1])
    out = review.first_template(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(templates, TEMPLATES), ["g"], F.abs(F.col("x") - F.col("y")) <= 0.2)
    assert {(r.g, r.template_id, r.n_alike, r.n) for r in out.collect()} == _all_pairs(frames, templates, 0.2)
    assert sum(n.startswith("found") for n in asked) > 3


def test_first_template_stops_at_the_first_that_fits(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(review.Scratch, "write", lambda self, df, name, write=review.Scratch.write: (asked.append((name, out := write(self, df, name))), out)[1])
    frames = spark.range(40).select(F.lit("a").alias("g"), F.lit(0).alias("shape"), F.lit(0.5).alias("x"))
    templates = spark.range(5000).select(F.lit(0).alias("shape"), F.col("id").alias("template_id"), F.col("id").alias("made_at"), F.lit(0.5).alias("y"))
    out = review.first_template(frames, templates, ["g"], F.col("x") == F.col("y")).collect()
    assert [tuple(r) for r in out] == [("a", 4999, 40, 40)]
    assert sum(df.count() for name, df in asked if name.startswith("asked")) == review.FEW


def test_first_template_without_templates(spark):
    frames, templates = spark.createDataFrame([("a", 0, 0.5)], FRAMES), spark.createDataFrame([], TEMPLATES)
    assert review.first_template(frames, templates, ["g"], F.col("x") == F.col("y")).collect() == []
