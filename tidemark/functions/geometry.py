"""Rectangles as structs (x0, y0, x1, y1) of fractions, and the vertical crop around one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle with ordered corners inside of the unit square."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.struct(unit(F.least(x0, x1)).alias("x0"), unit(F.least(y0, y1)).alias("y0"), unit(F.greatest(x0, x1)).alias("x1"), unit(F.greatest(y0, y1)).alias("y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def common(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    both = common(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def even(x: Column) -> Column:
    """Nearest even whole number at or above 2, halves to even."""
    return F.greatest(F.lit(2), (2 * F.bround(x / 2)).cast("int"))


def vertical_crop(b: Column, width: Column, height: Column, fill: float = 0.78, aspect: float = 1.18) -> Column:
    """(x, y, w, h) in pixels: as wide as the rectangle over ``fill``, full height; a crop narrower than tall takes ``aspect``."""
    h = height - height % 2
    most = width - width % 2
    bug_w = (b["x1"] - b["x0"]) * width
    own = F.least(width.cast("double"), bug_w / fill)
    wide = own >= h
    w = F.least(F.when(wide, even(own)).otherwise(even(aspect * h)), most)
    centred = F.bround((b["x0"] + b["x1"]) / 2 * width - w / 2).cast("int")
    mid = F.bround(width / 2 - w / 2).cast("int")
    left, right = b["x0"] * width, b["x1"] * width
    shifted = F.when(right > F.when(left < mid, F.floor(left)).otherwise(mid) + w, F.bround(right - w)).otherwise(F.when(left < mid, F.floor(left)).otherwise(mid)).cast("int")
    x = F.greatest(F.lit(0), F.least(width - w, F.when(wide, centred).otherwise(shifted)))
    return F.struct(x.alias("x"), F.lit(0).alias("y"), w.alias("w"), h.alias("h"))
