"""Queries of grids, boxes and masked decoding, on embeddings as grids of eight by eight cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import arrays, fields, grids
from tidemark.sources.files import table

WIDTH = 8
FRAME = ["frame"]


def _grids(spark, sf_dir):
    """vec_id, cells (whole numbers, so that sums are exact), width, mask."""
    cells = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", cells.alias("cells"), F.lit(WIDTH).alias("width"))
    return e.withColumn("mask", F.transform("cells", lambda x: x > 0))


def _boxes(spark, sf_dir):
    """Text boxes in whole pixels: ten to a frame."""
    px = lambda i, scale: F.floor(F.abs(F.col("embedding")[i].cast("double")) * scale).cast("int")
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("frame"), F.col("vec_id").alias("id"), px(0, 1600).alias("x0"), px(1, 200).alias("y0"), px(2, 300).alias("w"), px(3, 100).alias("h"))
    return e.select("frame", "id", "x0", "y0", (F.col("x0") + F.col("w") + 1).alias("x1"), (F.col("y0") + F.col("h") + 1).alias("y1"))


def _outer():
    return F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(1500).alias("x1"), F.lit(180).alias("y1"))


def _regions(spark, sf_dir, corners):
    found = grids.regions(_grids(spark, sf_dir).select("vec_id", "mask", "width"), "mask", "width", corners)
    return found.select("vec_id", F.explode("regions").alias("r")).select("vec_id", "r.*")


def grid_regions(spark, sf_dir):
    return _regions(spark, sf_dir, True)


def grid_regions_by_sides(spark, sf_dir):
    return _regions(spark, sf_dir, False)


def grid_labels(spark, sf_dir):
    """The label of each cell, as one text."""
    found = grids.regions(_grids(spark, sf_dir).select("vec_id", "mask", "width"), "mask", "width")
    return found.select("vec_id", F.concat_ws(",", F.transform("labels", lambda x: x.cast("string"))).alias("labels"))


def grid_growth(spark, sf_dir):
    """The region at the middle of each grid, without ragged edges, grown over steady cells."""
    seed = F.struct(*(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (3, 3, 5, 5))))
    found = grids.regions(_grids(spark, sf_dir), "mask", "width").withColumn("region", grids.region_at(F.col("labels"), F.col("regions"), F.col("width"), seed))
    box = found.withColumn("box", F.struct(*(F.col("region")[c].alias(c) for c in ("x0", "y0", "x1", "y1")))).filter("region IS NOT NULL")
    own = box.withColumn("own", F.transform("labels", lambda x: x == F.col("region.label")))
    out = grids.settled_box(own.select("vec_id", "own", "cells", "width", "box", F.lit(20.0).alias("soft")), "own", "cells", "width", "box", 0.6, 2, "soft", 3, 2)
    return out.select("vec_id", "settled.*")


def shrink_search(spark, sf_dir):
    """Ten grids are the frames of one field; a box reads where its mean is above 2, and then its sum."""
    box = F.struct(*(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (1, 1, 7, 8))))
    g = _grids(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).alias("frame"), "vec_id", "cells", "width", box.alias("box"))
    sums = grids.shrunken_sums(g, "cells", "width", "box").select("frame", "vec_id", "candidate", "total", "area")
    reads = sums.withColumn("value", F.when(F.col("total") > 2 * F.col("area"), F.col("total")))
    return grids.best_candidates(reads, FRAME, ["vec_id"], "value", 0.5)


def field_neighbours(spark, sf_dir):
    return grids.row_neighbours(_boxes(spark, sf_dir), FRAME, "id")


def field_padding(spark, sf_dir):
    h = F.col("y1") - F.col("y0")
    b = _boxes(spark, sf_dir).withColumns({"outer": _outer(), "pad_x": F.floor(h * 3 / 4).cast("int"), "pad_y": F.greatest(F.lit(1), F.floor(h / 5).cast("int"))})
    return grids.padded(b, FRAME, "id", "outer", F.col("pad_x"), F.col("pad_y")).select("frame", "id", "x0", "y0", "x1", "y1")


def field_separation(spark, sf_dir):
    texts = _boxes(spark, sf_dir)
    snapped = texts.withColumns({"x0": F.col("x0") - 40, "x1": F.col("x1") + 60})
    return grids.separated(snapped, texts, FRAME, "id")


def free_run(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("steps"))
    at, limit = (F.col("vec_id") % 64).cast("int"), (F.col("vec_id") % 23).cast("int")
    return e.select("vec_id", grids.free_run(F.col("steps"), at, limit, 0.15).alias("ahead"), grids.free_run(F.col("steps"), at, limit, 0.15, back=True).alias("behind"))


def masked_decode(spark, sf_dir):
    """Eight steps over eight classes; of odd vectors only half of the classes are allowed."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda x: F.round(x.cast("double"), 2) + 0.0))
    symbols = F.array(*map(F.lit, ["", *"0123:.4"]))
    allowed = F.when(F.col("vec_id") % 2 == 0, F.array(*map(F.lit, range(8)))).otherwise(F.array(*map(F.lit, (0, 1, 2, 5))))
    e = table(spark, sf_dir, "embeddings").select("vec_id", arrays.masked_decode(steps, symbols, allowed).alias("d"))
    return e.select("vec_id", "d.text", "d.confidence")


CELLS = f"""g AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)) AS cells FROM embeddings),
  c AS (SELECT vec_id, unnest(cells) AS v, unnest(range(0, len(cells))) AS i FROM g), m AS (SELECT vec_id, i, i // {WIDTH} AS y, i % {WIDTH} AS x FROM c WHERE v > 0)"""


def flooded(corners: bool) -> str:
    """The cells that each set cell reaches, step by step; its label is the least of them."""
    step = "greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1" if corners else "abs(a.x - b.x) + abs(a.y - b.y) = 1"
    return f"""{CELLS}, near AS (SELECT a.vec_id, a.i, b.i AS j FROM m a JOIN m b ON a.vec_id = b.vec_id AND {step}),
  flood AS (SELECT vec_id, i, i AS r FROM m UNION SELECT f.vec_id, n.j, f.r FROM flood f JOIN near n ON f.vec_id = n.vec_id AND f.i = n.i AND n.j > f.r),
  least AS (SELECT vec_id, i, min(r) AS r FROM (SELECT vec_id, i, r FROM flood UNION ALL SELECT vec_id, r, i FROM flood) GROUP BY ALL),
  root AS (SELECT l.vec_id, l.i, min(k.r) AS r FROM least l JOIN least k ON k.vec_id = l.vec_id AND k.i = l.r GROUP BY ALL),
  lab AS (SELECT vec_id, i, i // {WIDTH} AS y, i % {WIDTH} AS x, dense_rank() OVER (PARTITION BY vec_id ORDER BY r) AS label FROM root)"""


REGION = "SELECT vec_id, label::INT AS label, min(x)::INT AS x0, min(y)::INT AS y0, (max(x) + 1)::INT AS x1, (max(y) + 1)::INT AS y1, count(*)::INT AS cells FROM lab GROUP BY vec_id, label"
BOXES = """b AS (SELECT vec_id // 10 AS frame, vec_id AS id, floor(abs(embedding[1]::DOUBLE) * 1600)::INT AS x0, floor(abs(embedding[2]::DOUBLE) * 200)::INT AS y0,
    floor(abs(embedding[1]::DOUBLE) * 1600)::INT + floor(abs(embedding[3]::DOUBLE) * 300)::INT + 1 AS x1, floor(abs(embedding[2]::DOUBLE) * 200)::INT + floor(abs(embedding[4]::DOUBLE) * 100)::INT + 1 AS y1 FROM embeddings)"""


def beside(name: str, src: str, u: str, v: str) -> str:
    """The nearest others on both sides along ``u`` that overlap along ``v``."""
    return f"""{name} AS (SELECT a.frame, a.id, max(CASE WHEN o.{u}1 <= a.{u}0 THEN o.{u}1 END) AS before, min(CASE WHEN o.{u}0 >= a.{u}1 THEN o.{u}0 END) AS after
    FROM {src} a LEFT JOIN {src} o ON o.frame = a.frame AND o.id <> a.id AND o.{v}1 > a.{v}0 AND o.{v}0 < a.{v}1 GROUP BY a.frame, a.id)"""


def moved(low: str, high: str) -> str:
    return f"greatest(0, least(p, coalesce((({high}) - ({low})) // 2, p), "


GROWN = """
  seed AS (SELECT vec_id, label, count(*) AS n FROM lab WHERE x IN (3, 4) AND y IN (3, 4) GROUP BY ALL),
  chosen AS (SELECT vec_id, label FROM seed QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1),
  box AS (SELECT l.vec_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM lab l JOIN chosen USING (vec_id, label) GROUP BY l.vec_id),
  own AS (SELECT b.*, list_transform(range(0, 64), lambda i: CASE WHEN list_contains(o.l, i) THEN 1.0 ELSE 0.0 END) AS s, g.cells AS v FROM box b
    JOIN (SELECT l.vec_id, list(i) AS l FROM lab l JOIN chosen USING (vec_id, label) GROUP BY l.vec_id) o USING (vec_id) JOIN g USING (vec_id)),"""


def line_mean(cells: str, k: str, low: str, high: str, columns: bool) -> str:
    at = f"{cells}[(j * 8 + {k} + 1)::BIGINT]" if columns else f"{cells}[({k} * 8 + j + 1)::BIGINT]"
    return f"list_avg(list_transform(range({low}, {high}), lambda j: {at}))"


def steps_while(test: str, limit: str) -> str:
    """How many of the places 0, 1, ... pass a test on ``q`` in a row, at most ``limit``."""
    return f"coalesce(list_min(list_filter(range(0, greatest(0, {limit})), lambda q: NOT coalesce({test}, false))), greatest(0, {limit}))"


def growth_sql() -> str:
    cut = lambda k, lo, hi, columns: f"{line_mean('s', k, lo, hi, columns)} < 0.6"
    soft = lambda k, lo, hi, columns: f"{line_mean('v', k, lo, hi, columns)} < 20"
    stages = [
        ("y0", f"y0 + {steps_while(cut('(y0 + q)', 'x0', 'x1', False), 'y1 - y0 - 2')}"), ("y1", f"y1 - {steps_while(cut('(y1 - 1 - q)', 'x0', 'x1', False), 'y1 - y0 - 2')}"),
        ("x0", f"x0 + {steps_while(cut('(x0 + q)', 'y0', 'y1', True), 'x1 - x0 - 2')}"), ("x1", f"x1 - {steps_while(cut('(x1 - 1 - q)', 'y0', 'y1', True), 'x1 - x0 - 2')}"),
        ("x0", f"x0 - {steps_while(soft('(x0 - 1 - q)', 'y0', 'y1', True), 'least(3, x0)')}"), ("x1", f"x1 + {steps_while(soft('(x1 + q)', 'y0', 'y1', True), 'least(3, 8 - x1)')}"),
        ("y0", f"y0 - {steps_while(soft('(y0 - 1 - q)', 'x0', 'x1', False), 'least(2, y0)')}"), ("y1", f"y1 + {steps_while(soft('(y1 + q)', 'x0', 'x1', False), 'least(2, 8 - y1)')}"),
    ]
    parts, last = [], "own"
    for n, (side, value) in enumerate(stages):
        parts.append(f"t{n} AS MATERIALIZED (SELECT * REPLACE ({value} AS {side}) FROM {last})")
        last = f"t{n}"
    return f"WITH RECURSIVE {flooded(True)}, {GROWN} {', '.join(parts)} SELECT vec_id, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM {last}"


def shrink_sql() -> str:
    tries = ", ".join(f"({k}, {a}, {b}, {c}, {d})" for k, (a, b, c, d) in enumerate(grids.SHRINKS))
    return f"""WITH {CELLS}, s(candidate, top, bottom, "left", "right") AS (VALUES {tries}),
  e AS (SELECT candidate, 1 + floor("left" * 6 + 0.5) AS x0, 7 - floor("right" * 6 + 0.5) AS x1, 1 + floor(top * 7 + 0.5) AS y0, 8 - floor(bottom * 7 + 0.5) AS y1 FROM s),
  t AS (SELECT vec_id, candidate, sum(v) AS total, count(*) AS cells FROM c JOIN e ON i % 8 >= x0 AND i % 8 < x1 AND i // 8 >= y0 AND i // 8 < y1 GROUP BY ALL),
  r AS (SELECT vec_id // 10 AS frame, vec_id, candidate, CASE WHEN total > 2 * cells THEN total END AS value FROM t),
  f AS (SELECT *, lag(value IGNORE NULLS) OVER (PARTITION BY frame, candidate ORDER BY vec_id) AS prev FROM r),
  p AS (SELECT frame, candidate, count(value) AS n_read, count(*) FILTER (value < prev) AS n_falls, count(*) AS n FROM f GROUP BY ALL)
  SELECT frame, candidate::INT AS candidate, n_read, n_falls FROM p
  QUALIFY row_number() OVER (PARTITION BY frame ORDER BY (candidate = 0 AND n_read >= 0.5 * n AND n_falls = 0) DESC, n_read DESC, n_falls, candidate) = 1"""


SQL = {
    "grid_regions": f"WITH RECURSIVE {flooded(True)} {REGION}",
    "grid_regions_by_sides": f"WITH RECURSIVE {flooded(False)} {REGION}",
    "grid_labels": f"WITH RECURSIVE {flooded(True)} SELECT c.vec_id, string_agg(coalesce(label, 0)::VARCHAR, ',' ORDER BY c.i) AS labels FROM c LEFT JOIN lab ON lab.vec_id = c.vec_id AND lab.i = c.i GROUP BY c.vec_id",
    "grid_growth": growth_sql(),
    "shrink_search": shrink_sql(),
    "field_neighbours": f"WITH {BOXES}, {beside('n', 'b', 'x', 'y')} SELECT * FROM n",
    "field_padding": f"""WITH {BOXES}, {beside('n', 'b', 'x', 'y')},
  w AS (SELECT frame, id, b.x0 - {moved('before', 'b.x0')} b.x0)) AS x0, b.x1 + {moved('b.x1', 'after')} 1500 - b.x1)) AS x1, y0, y1, greatest(1, (y1 - y0) // 5) AS pad FROM (SELECT *, (y1 - y0) * 3 // 4 AS p FROM b) b JOIN n USING (frame, id)),
  {beside('k', 'w', 'y', 'x')}
  SELECT frame, id, x0, (y0 - {moved('before', 'y0')} y0)))::INT AS y0, x1, (y1 + {moved('y1', 'after')} 180 - y1)))::INT AS y1 FROM (SELECT *, pad AS p FROM w) JOIN k USING (frame, id)""",
    "field_separation": f"WITH {BOXES}, {beside('n', 'b', 'x', 'y')} SELECT frame, id, greatest(x0 - 40, before) AS x0, y0, least(x1 + 60, after) AS x1, y1 FROM b JOIN n USING (frame, id)",
    "free_run": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS s, vec_id % 64 AS a, vec_id % 23 AS n FROM embeddings)
  SELECT vec_id, coalesce(list_min(list_filter(range(0, least(n, 64 - a)), lambda k: s[a + k + 1] > 0.15)), least(n, 64 - a))::INT AS ahead,
    coalesce(list_min(list_filter(range(0, least(n, a)), lambda k: s[a - k] > 0.15)), least(n, a))::INT AS behind FROM e""",
    "masked_decode": """WITH e AS (SELECT vec_id, unnest(range(0, 8)) AS t, embedding, CASE WHEN vec_id % 2 = 0 THEN [0, 1, 2, 3, 4, 5, 6, 7] ELSE [0, 1, 2, 5] END AS allowed FROM embeddings),
  p AS (SELECT vec_id, t, k, round(embedding[t * 8 + k + 1]::DOUBLE, 2) + 0.0 AS p FROM (SELECT *, unnest(allowed) AS k FROM e)),
  b AS (SELECT vec_id, t, k, p, lag(k, 1, -1) OVER (PARTITION BY vec_id ORDER BY t) AS prev FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id, t ORDER BY p DESC, k) = 1)),
  d AS (SELECT vec_id, string_agg(['', '0', '1', '2', '3', ':', '.', '4'][k + 1], '' ORDER BY t) AS text, min(p) AS confidence FROM b WHERE k <> prev AND k <> 0 GROUP BY vec_id)
  SELECT e.vec_id, coalesce(text, '') AS text, coalesce(confidence, 0) AS confidence FROM embeddings e LEFT JOIN d USING (vec_id)""",
}
QUERIES = {
    f.__name__: f
    for f in (grid_regions, grid_regions_by_sides, grid_labels, grid_growth, shrink_search, field_neighbours, field_padding, field_separation, free_run, masked_decode)
}


def _texts(spark, sf_dir):
    """Text boxes of labels as sources, ten places each: every place is hit by many vectors, a little off."""
    e = table(spark, sf_dir, "embeddings")
    off = lambda i: F.col("embedding")[i].cast("double") / 100
    place = F.col("vec_id") % 10
    x, y = place % 5 * 0.2 + 0.02 + off(0), F.floor(place / 5) * 0.4 + 0.1 + off(1)
    return e.select("label", F.col("vec_id").alias("id"), (F.col("vec_id") % 4 == 0).alias("split"), x.alias("x0"), y.alias("y0"), (x + 0.12 + off(2)).alias("x1"), (y + 0.06 + off(3)).alias("y1"))


def field_clusters(spark, sf_dir):
    out = fields.field_boxes(fields.clusters(_texts(spark, sf_dir), ["label"], 0.25), ["label"])
    return out.select("label", "field", "n", *(F.round(c, 9).alias(c) for c in out.columns[3:]))


# a place's boxes are alike enough to be one field, whose first member is its least exact id
SQL["field_clusters"] = """WITH e AS (SELECT label, vec_id AS id, vec_id % 4 = 0 AS split, vec_id % 10 AS place, list_transform(embedding, lambda x: x::DOUBLE / 100) AS o FROM embeddings),
  p AS (SELECT label, id, split, place, place % 5 * 0.2::DOUBLE + 0.02::DOUBLE + o[1] AS x0, place // 5 * 0.4::DOUBLE + 0.1::DOUBLE + o[2] AS y0, o FROM e),
  b AS (SELECT label, id, split, place, x0, y0, x0 + 0.12::DOUBLE + o[3] AS x1, y0 + 0.06::DOUBLE + o[4] AS y1 FROM p),
  g AS (SELECT label, coalesce(min(id) FILTER (NOT split), min(id)) AS field, count(*) AS n, list(x0 ORDER BY x0)[count(*) // 2 + 1] AS x0, list(y0 ORDER BY y0)[count(*) // 2 + 1] AS y0, list(x1 ORDER BY x1)[count(*) // 2 + 1] AS x1, list(y1 ORDER BY y1)[count(*) // 2 + 1] AS y1,
    coalesce(min(x0) FILTER (NOT split), min(x0)) AS union_x0, coalesce(min(y0) FILTER (NOT split), min(y0)) AS union_y0, coalesce(max(x1) FILTER (NOT split), max(x1)) AS union_x1, coalesce(max(y1) FILTER (NOT split), max(y1)) AS union_y1 FROM b GROUP BY label, place)
  SELECT label, field, n, round(x0, 9) AS x0, round(y0, 9) AS y0, round(x1, 9) AS x1, round(y1, 9) AS y1, round(union_x0, 9) AS union_x0, round(union_y0, 9) AS union_y0, round(union_x1, 9) AS union_x1, round(union_y1, 9) AS union_y1 FROM g"""
QUERIES["field_clusters"] = field_clusters
