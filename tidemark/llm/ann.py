"""Approximate nearest neighbours: few stable projections, a kd-tree over them, a chi-square stopping test.

``PROJECTIONS`` normally distributed directions take a vector to a short one. The squared
projected distance of two vectors, divided by their squared distance, follows the chi-square
distribution with as many degrees, whatever the data. So if the k-th neighbour found so far is at
distance d, a nearer one lies within d * sqrt(quantile(SURE)) of the query in projection with
probability ``SURE``: candidates are verified in the order of their projected distance until the
next one lies beyond that radius, which shrinks as nearer neighbours are found.

The tree has two levels. Splits fitted on a bounded sample of projections (``SAMPLE`` rows) deal all
rows into cells; rows of a cell are dealt by hash into blocks of about ``BLOCK``, each with its own
tree of leaves. A query first searches the blocks of its own cell; its radius then names the other
cells it must visit, and it searches those. Both sides of a search are bounded: a block, and a share of
its queries. Only cells' boxes are sent to all tasks (at most one cell for eight sampled rows).

Equal vectors are one entry that carries its smallest ids (one more than asked for, as a
query finds itself), so copies cost nothing, however many; equal query vectors search once.

Defined results. Rows with a null id, and vectors that are null, empty, zero, or hold null or
non-finite components take no part. Vectors of different lengths are never compared. A row with the
query's id counts as the query's own; an id with several vectors is a candidate with each, and a
query with each. Rows repeated in full count once. Ties go to the smaller id. Fewer candidates
than asked for give all of them. Distances beyond double precision are computed on
scaled-down vectors. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import Scratch, read, tidied

NEIGHBOURS = 10
#: Dimensions of projections (an even number) and probability with which the stopping test keeps a nearer neighbour.
PROJECTIONS, SURE = 8, 0.975
#: Rows that the splits are fitted on, distinct vectors of a block, asked vectors that search it in one task, and the most cells for a length.
SAMPLE, BLOCK, ASKED, CELLS = 65_536, 4096, 2048, 4096
LEAF = 32


def chi_square_quantile(share: float, degrees: int) -> float:
    """Where the distribution function of an even number of degrees reaches ``share``."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
        low, high = (x, high) if below < share else (low, x)
    return high


#: Radius of the stopping test for a distance of one.
REACH = math.sqrt(chi_square_quantile(SURE, PROJECTIONS))


@lru_cache(maxsize=16)
def directions(length: int) -> np.ndarray:
    return np.random.default_rng([length, PROJECTIONS]).standard_normal((length, PROJECTIONS))


def projected(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nan_to_num(x @ directions(x.shape[1]), nan=0.0, posinf=1e300, neginf=-1e300).clip(-1e300, 1e300)


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = rows - q
        out = np.sqrt(np.einsum("ij,ij->i", d, d))
        bad = ~np.isfinite(out)
        if bad.any():
            scale = 2.0**-520
            d = rows[bad] * scale - q * scale
            out[bad] = np.sqrt(np.einsum("ij,ij->i", d, d)) / scale
    return out


def splits(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A kd-tree as a heap of (dimension, value), -1 where a node is not split: widest dimension, at its median."""
    depth = max(0, math.ceil(math.log2(max(1, cells))))
    out = [(-1, 0.0)] * (2**depth - 1)
    held = {0: sample}
    for node in range(2**depth - 1):
        rows = held.pop(node, None)
        if rows is None or len(rows) < 2:
            continue
        k = int((rows.max(0) - rows.min(0)).argmax())
        at = float(np.median(rows[:, k]))
        left = rows[:, k] <= at
        if left.all():
            continue
        out[node] = (k, at)
        held[2 * node + 1], held[2 * node + 2] = rows[left], rows[~left]
    return out


def cell_of(tree: list[tuple[int, float]], rows: np.ndarray) -> np.ndarray:
    """The place in the heap where each row comes to rest."""
    at = np.zeros(len(rows), np.int64)
    if not tree:
        return at
    dim, value = np.array([k for k, _ in tree]), np.array([v for _, v in tree])
    while True:
        inner = np.flatnonzero(at < len(tree))
        inner = inner[dim[at[inner]] >= 0]
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = 2 * node + 1 + (rows[inner, dim[node]] > value[node])


class Leaves:
    """The kd-tree of a block: rows in the order of its leaves, and the leaves' boxes."""

    def __init__(self, low: np.ndarray):
        order, edges, todo = [], [], [np.arange(len(low))]
        while todo:
            rows = todo.pop()
            if len(rows) > LEAF:
                k = int(np.ptp(low[rows], axis=0).argmax())
                half = len(rows) // 2
                parts = rows[np.argpartition(low[rows, k], half)]
                todo += [parts[:half], parts[half:]]
            else:
                order.append(rows)
                edges.append(len(rows))
        self.order = np.concatenate(order)
        self.start = np.concatenate([[0], np.cumsum(edges)[:-1]])
        self.end = np.cumsum(edges)
        self.low = low[self.order]
        self.least = np.minimum.reduceat(self.low, self.start)
        self.most = np.maximum.reduceat(self.low, self.start)

    def nearest_first(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by the distance of their boxes from ``q``, and those distances."""
        away = np.maximum(np.maximum(self.least - q, q - self.most), 0)
        d = np.sqrt((away**2).sum(1))
        order = np.argsort(d, kind="stable")
        return order, d[order]


def search(leaves: Leaves, full: np.ndarray, ids: list[list[int]], q_low: np.ndarray, q: np.ndarray, found: float, k: int) -> list[tuple[float, int]]:
    """The ``k`` nearest (distance, id) among the block's rows within ``found``, verified until the stopping test holds."""
    order, away = leaves.nearest_first(q_low)
    best: list[tuple[float, int]] = []
    bound, at, step = found, 0, 4
    while at < len(order) and away[at] <= bound * REACH:
        stop = min(at + step, int(np.searchsorted(away, bound * REACH, side="right")))
        rows = np.concatenate([np.arange(leaves.start[x], leaves.end[x]) for x in order[at:stop]])
        low = leaves.low[rows] - q_low
        rows = rows[np.einsum("ij,ij->i", low, low) <= (bound * REACH) ** 2]
        exact = distances(full[rows], q)
        for r in np.flatnonzero(exact <= bound):
            best += [(float(exact[r]), x) for x in ids[rows[r]]]
        best = sorted(best)[:k]
        if len(best) == k:
            bound = min(bound, best[-1][0])
        at, step = stop, 2 * step
    return best


def entries(table: DataFrame) -> DataFrame:
    """vec_id, vector (its components' bytes) and length, of rows that take part; full repeats once."""
    kind = number_type(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("length").to_numpy()
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros((), kind)  # no negative zeros
            ends = np.cumsum(width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([flat[e - w : e].tobytes() for e, w in zip(ends, width)], pa.binary()), batch.column("length")], names=["vec_id", "vector", "length"])

    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    kept = table.filter(F.col("vec_id").isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("length"))
    return kept.mapInArrow(tidied(run), "vec_id long, vector binary, length int").dropDuplicates(["vec_id", "length", "vector"])


def number_type(table: DataFrame) -> str:
    return "<f4" if table.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """vector, length, ids: its ``ids`` smallest ids, cut in every task before the shuffle and again after it."""
    rank = F.row_number().over(Window.partitionBy("length", "vector").orderBy("vec_id"))
    return rows.withColumn("k", rank).filter(F.col("k") <= ids).groupBy("length", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(values: list[bytes], kind: str, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).astype(np.float64).reshape(-1, length)


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, PROJECTIONS)


def placed(vectors: DataFrame, kind: str, trees: dict[int, list]) -> DataFrame:
    """``vectors`` with their projection ``low`` and their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            low, cell = np.zeros((len(batch), PROJECTIONS)), np.zeros(len(batch), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                low[at] = projected(_matrix(batch.column("vector").take(pa.array(at)).to_pylist(), kind, n))
                cell[at] = cell_of(trees.get(int(n), []), low[at])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, low.size + 1, PROJECTIONS), pa.int32()), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(cell)], names=[*batch.schema.names, "low", "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(tidied(run), f"{schema}, low array<double>, cell long")


def fit(vectors: DataFrame, kind: str, sizes: dict[int, int]) -> dict[int, list]:
    """Splits for lengths of ``sizes``, from at most ``SAMPLE`` vectors chosen by hash."""
    if not sizes:
        return {}
    share = min(1.0, 0.95 * SAMPLE / sum(sizes.values()))
    chosen = vectors.filter(F.col("length").isin(list(sizes)) & (F.pmod(F.xxhash64("vector"), F.lit(1 << 40)) < int(share * (1 << 40))))
    by: dict[int, list] = {}
    for r in placed(chosen.select("length", "vector"), kind, {}).select("length", "low").limit(SAMPLE).collect():
        by.setdefault(r.length, []).append(r.low)
    return {n: splits(np.array(x), min(CELLS, len(x) // 8, -(-sizes[n] // BLOCK))) for n, x in by.items()}


def searched(indexed: DataFrame, asked: DataFrame, kind: str, parts: dict[tuple[int, int], tuple[int, int]], k: int) -> DataFrame:
    """length, vector, distance, vec_id: up to ``k`` neighbours of ``asked`` vectors from each block of the cell asked.

    ``parts`` has the number of blocks, and of shares of the asked vectors, of cells that are more than one block.
    """
    names = ["length", "cell", "block", "share"]
    # a row for each of at most SAMPLE / 8 cells
    known = F.broadcast(indexed.sparkSession.createDataFrame([(*c, *x) for c, x in parts.items()], "length int, cell long, blocks int, shares int"))
    numbers = {"blocks": F.coalesce("blocks", F.lit(1)), "shares": F.coalesce("shares", F.lit(1))}
    of = lambda n, salt: F.pmod(F.xxhash64("vector", F.lit(salt)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = indexed.join(known, ["length", "cell"], "left").withColumns(numbers).withColumn("block", of("blocks", 1)).withColumn("share", each("shares"))
    two = asked.join(known, ["length", "cell"], "left").withColumns(numbers).withColumn("share", of("shares", 2)).withColumn("block", each("blocks"))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        vector, length, distance, vec_id = [], [], [], []
        if len(rows) and len(queries):
            n = rows.column("length")[0].as_py()
            leaves = Leaves(_lists(rows.column("low")))
            full, ids = _matrix(rows.column("vector").to_pylist(), kind, n)[leaves.order], rows.column("ids").to_pylist()
            ids, asked_vectors = [ids[r] for r in leaves.order], queries.column("vector").to_pylist()
            for v, low, q, found in zip(asked_vectors, _lists(queries.column("low")), _matrix(asked_vectors, kind, n), queries.column("found").to_pylist()):
                best = search(leaves, full, ids, low, q, math.inf if found is None else found, k)
                vector += [v] * len(best)
                length += [n] * len(best)
                distance += [d for d, _ in best]
                vec_id += [x for _, x in best]
        return pa.table({"length": pa.array(length, pa.int32()), "vector": pa.array(vector, pa.binary()), "distance": pa.array(distance, pa.float64()), "vec_id": pa.array(vec_id, pa.int64())})

    groups = two.select(*names, "vector", "low", "found").groupBy(*names)
    return one.select(*names, "vector", "low", "ids").groupBy(*names).cogroup(groups).applyInArrow(run, "length int, vector binary, distance double, vec_id long")


def other_cells(asked: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """``asked`` for each cell but its own whose box the stopping radius reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, length, low = batch.column("cell").to_numpy(), batch.column("length").to_numpy(), batch.column("low").flatten().to_numpy().reshape(-1, PROJECTIONS)
            found = [math.inf if x is None else x for x in batch.column("found").to_pylist()]
            for r in range(len(batch)):
                cells, least, most = boxes[int(length[r])]
                away = np.maximum(np.maximum(least - low[r], low[r] - most), 0)
                to = cells[((away**2).sum(1) <= (found[r] * REACH) ** 2) & (cells != own[r])]
                if len(to):
                    part = batch.take(pa.array([r] * len(to)))
                    yield part.set_column(part.schema.get_field_index("cell"), "cell", pa.array(to, pa.int64()))

    columns = asked.select("length", "vector", "low", "cell", "found")
    return columns.mapInArrow(tidied(run), "length int, vector binary, low array<double>, cell long, found double")


def neighbours_of(spark: SparkSession, table: DataFrame, every: int = 100, neighbours: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the neighbours of every row whose id is divisible by ``every``."""
    scratch, kind, k = Scratch(spark, "ann"), number_type(table), neighbours + 1
    rows = scratch.write(entries(table), "entries")
    queries = scratch.write(rows.filter(F.col("vec_id") % every == 0), "queries")
    vectors = scratch.write(distinct_vectors(rows, k), "vectors")
    scratch.drop("entries")
    # lengths of more than one block; all others are one cell, numbered 0, of one block
    sizes = {r.length: r["count"] for r in vectors.groupBy("length").count().filter(F.col("count") > BLOCK).orderBy(F.desc("count"), "length").limit(CELLS).collect()}
    trees = fit(vectors, kind, sizes)
    indexed = scratch.write(placed(vectors.select("length", "vector", "ids"), kind, trees), "indexed")
    scratch.drop("vectors")
    asked = scratch.write(placed(queries.select("length", "vector").distinct(), kind, trees), "asked")

    large = F.col("length").isin(list(sizes))
    low = [F.col("low")[j] for j in range(PROJECTIONS)]
    cells = indexed.filter(large).groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.min, low)).alias("least"), F.array(*map(F.max, low)).alias("most")).collect()
    of_cell = {(r.length, r.cell): r["count"] for r in asked.filter(large).groupBy("length", "cell").count().collect()}
    boxes = {n: tuple(np.array([r[c] for r in cells if r.length == n]) for c in ("cell", "least", "most")) for n in {r.length for r in cells}}
    blocks = {(r.length, r.cell): -(-r.n // BLOCK) for r in cells}

    split = lambda counts: {c: (b, -(-counts.get(c, 1) // ASKED)) for c, b in blocks.items()}
    first = scratch.write(_best(searched(indexed, asked.withColumn("found", F.lit(None).cast("double")), kind, split(of_cell), k), k), "first")
    bound = first.groupBy("length", "vector").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("found"))
    found = first
    if boxes:
        more = scratch.write(other_cells(asked.filter(large).join(bound, ["length", "vector"], "left"), boxes), "more")
        counts = {(r.length, r.cell): r["count"] for r in more.groupBy("length", "cell").count().collect()}
        found = _best(first.unionByName(searched(indexed, more, kind, split(counts), k)), k)
    answers = scratch.write(found.groupBy("length", "vector").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("best")), "answers")
    own = F.filter("best", lambda x: x["vec_id"] != F.col("query_id"))
    listed = queries.withColumnRenamed("vec_id", "query_id").join(answers, ["length", "vector"]).select("query_id", F.posexplode(F.slice(own, 1, neighbours)).alias("at", "hit"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.distance").alias("score"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("length", "vector").orderBy("distance", "vec_id"))
    return found.withColumn("k", rank).filter(F.col("k") <= k).drop("k")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours_of(spark, read(spark, sf_dir, "embeddings"))


QUERIES = {"op13_neighbours": op13_neighbours}
