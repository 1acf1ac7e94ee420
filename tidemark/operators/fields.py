"""Text boxes of a source gathered to the fields they belong to: clusters with boxes by rank.

Boxes join the cluster they overlap most, and a cluster's box is the upper median of its members' edges,
so each choice hangs on those before. But it hangs only on boxes nearby: a source's canvas is cut
into cells, boxes that share or border on occupied cells are one neighbourhood, and neighbourhoods whose
bounds meet are one. Each is gathered by itself, so a source with many boxes is many small tasks.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import grids
from tidemark.operators.folds import spread

EDGES = ("x0", "y0", "x1", "y1")
#: Cells of a canvas along each side.
CELLS = 32
#: Overlap that a box counts for whose middle lies inside of a cluster's box (fixed value).
INSIDE = 0.5


def gathered(boxes: list[tuple], least: float) -> list[int]:
    """Cluster of each box (x0, y0, x1, y1), taken in order: the one of the largest overlap from ``least`` on, the first of equals, or a new one."""
    edges: list[list[list[float]]] = []  # of each cluster, its members' edges, sorted
    now: list[tuple[float, ...]] = []
    out = []
    for b in boxes:
        best, score = -1, 0.0
        middle, area = ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2), (b[2] - b[0]) * (b[3] - b[1])
        for k, c in enumerate(now):
            both = max(0.0, min(b[2], c[2]) - max(b[0], c[0])) * max(0.0, min(b[3], c[3]) - max(b[1], c[1]))
            union = area + (c[2] - c[0]) * (c[3] - c[1]) - both
            s = both / union if union > 0 else 0.0
            if c[0] <= middle[0] <= c[2] and c[1] <= middle[1] <= c[3]:
                s = max(s, INSIDE)
            if s > score:
                best, score = k, s
        if best < 0 or score < least:
            best = len(now)
            edges.append([[], [], [], []])
            now.append(())
        for held, x in zip(edges[best], b, strict=True):
            bisect.insort(held, x)
        now[best] = tuple(held[len(held) // 2] for held in edges[best])
        out.append(best)
    return out


def merged_bounds(bounds: np.ndarray) -> np.ndarray:
    """For rectangles (x0, y0, x1, y1 of cells, ends exclusive) the number of the whole that each is part of, wholes being rectangles that meet."""
    whole = np.arange(len(bounds))
    while True:
        rects = np.array([[*bounds[whole == w][:, :2].min(0), *bounds[whole == w][:, 2:].max(0)] for w in whole])
        meet = (rects[:, None, 0] <= rects[None, :, 2]) & (rects[None, :, 0] <= rects[:, None, 2]) & (rects[:, None, 1] <= rects[None, :, 3]) & (rects[None, :, 1] <= rects[:, None, 3])
        a, b = np.nonzero(meet)
        new = grids.roots(a, b, len(bounds))
        if (new == whole).all():
            return whole
        whole = new


def neighbourhoods(boxes: DataFrame, key: list[str], width: float, height: float) -> DataFrame:
    """``boxes`` with ``part``: the number of its neighbourhood within its source. Boxes beyond the canvas lie in its outer cells."""
    cell = lambda c, size: F.least(F.greatest(F.floor(F.col(c) / size * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    placed = boxes.withColumns({"_x0": cell("x0", width), "_x1": cell("x1", width), "_y0": cell("y0", height), "_y1": cell("y1", height)})
    rows = placed.select(*key, F.explode(F.sequence("_y0", "_y1")).alias("_y"), "_x0", "_x1")
    cells = rows.select(*key, F.explode(F.sequence(F.col("_y") * CELLS + F.col("_x0"), F.col("_y") * CELLS + F.col("_x1"))).alias("_c"))
    mask = cells.groupBy(*key).agg(F.collect_set("_c").alias("_set"))  # at most CELLS * CELLS
    full = mask.select(*key, F.transform(F.sequence(F.lit(0), F.lit(CELLS * CELLS - 1)), lambda i: F.array_contains("_set", i)).alias("_mask"), F.lit(CELLS).alias("_w"))
    found = grids.regions(full, "_mask", "_w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for labels, regions in zip(batch.column("labels"), batch.column("regions").to_pylist(), strict=True):
                whole = merged_bounds(np.array([[r[c] for c in EDGES] for r in regions])) if regions else np.zeros(0, int)
                parts.append(np.concatenate([[-1], whole])[labels.values.to_numpy()].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(parts, pa.list_(pa.int32()))], names=[*key, "_parts"])

    kinds = ", ".join(f"`{k}` {boxes.schema[k].dataType.simpleString()}" for k in key)
    numbered = found.select(*key, "labels", "regions").mapInArrow(run, f"{kinds}, _parts array<int>")
    return placed.join(numbered, key).withColumn("part", F.get("_parts", F.col("_y0") * CELLS + F.col("_x0"))).select(*boxes.columns, "part")


def clusters(boxes: DataFrame, key: list[str], least: float, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """key, id and ``field`` (the id of its first member) of boxes (id, x0..y1, split), and the field's box: exact boxes come before estimated ones, then by id.

    The box holds the upper median of each edge over all members, the union that of exact members if there are any.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["split", "id"])
        own = gathered(list(zip(*(rows[c].tolist() for c in EDGES), strict=True)), least)
        first = rows["id"].to_numpy()[np.array([own.index(k) for k in own], int)] if own else []
        return rows.assign(field=first)[[*key, "id", "field", "split", *EDGES]]

    near = neighbourhoods(boxes.select(*key, "id", "split", *EDGES), key, width, height)
    kinds = T.StructType([*(boxes.schema[k] for k in (*key, "id")), T.StructField("field", boxes.schema["id"].dataType), *(boxes.schema[c] for c in ("split", *EDGES))])
    return spread(near, [*key, "part"]).groupBy(*key, "part").applyInPandas(run, kinds)


def field_boxes(members: DataFrame, key: list[str]) -> DataFrame:
    """Of each field: its members, the upper median of each edge, and the bounds of its exact members (of all, if none is)."""
    upper = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(F.lit(1)) / 2).cast("int"))
    exact = lambda f, c: F.coalesce(f(F.when(~F.col("split"), F.col(c))), f(c)).alias(f"union_{c}")
    return members.groupBy(*key, "field").agg(F.count(F.lit(1)).alias("n"), *(upper(c).alias(c) for c in EDGES), exact(F.min, "x0"), exact(F.min, "y0"), exact(F.max, "x1"), exact(F.max, "y1"))
