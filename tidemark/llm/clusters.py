"""Centroid clustering in exact integers, with distances screened by segment norms.

A vector is compressed once: for each of its segments of ``SEGMENT`` components the sum, and the
norm of what the segment differs from its mean. By Cauchy and Schwarz the squared distance of two
segments is at least that of their means plus the square of the difference of those norms, so
compressed vectors and centroids alone bound every distance from below. The centroid of the least
bound is measured first; only centroids whose bound doesn't exceed that distance get theirs.

A round is one pass: tasks assign their vectors and add them up by cluster, and only those sums
move (clusters x components for each task). Centroids are the only rows that the driver sees.

Defined results. Vectors of another length than ``DIMS``, null vectors, and vectors with a null or
non-finite component are left out. A null id counts as an empty one in the hash; its vector is
clustered like any other. Repeated rows count as often as they occur; among equal hashes the
smaller components come first (those beyond ``NARROW`` after all others, as texts). Fewer vectors than clusters give as many centroids as vectors.
Components of any finite size are exact (beyond ``NARROW`` by Python's integers); a distance, sum
of distances beyond a long is null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import Scratch, read, tidied

DIMS, GRAIN, CLUSTERS, ROUNDS = 64, 64, 16, 3
SEGMENT = 8
#: Below this size of components all distances fit in 64 bits.
NARROW = 1 << 27
#: Bits of the pieces in which sums of components are added up.
LIMB = 30
#: Vectors that a task measures at a time.
CHUNK = 2048


def grained(x: float) -> int:
    """floor(GRAIN * x) of any finite number."""
    return math.floor(GRAIN * x) if abs(x) < 2**60 else GRAIN * int(x)


def compressed(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and norms of the differences from the mean, of each segment of each row."""
    parts = ints.reshape(len(ints), -1, SEGMENT)
    sums = parts.sum(2)
    spread = (parts.astype(np.float64) - sums[:, :, None] / SEGMENT) ** 2
    return sums.astype(np.float64), np.sqrt(spread.sum(2))


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, ints or wide (decimal texts, where a component doesn't fit), sums and norms of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), CHUNK):
                part = batch.slice(k, CHUNK)
                lists = part.column("embedding")
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMS)
                with np.errstate(over="ignore"):
                    whole = np.floor(GRAIN * x)
                small = (np.abs(whole) < NARROW).all(1)
                ints = np.where(small[:, None], whole, 0).astype(np.int32)
                sums, norms = compressed(ints.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"), pa.array([v if s else None for v, s in zip(ints, small)], pa.list_(pa.int32())),
                        pa.array([None if s else [str(grained(float(c))) for c in v] for v, s in zip(x, small)], pa.list_(pa.string())),
                        pa.array([v.tobytes() for v in sums.astype("<f8")], pa.binary()), pa.array([v.tobytes() for v in norms.astype("<f8")], pa.binary()),
                    ], names=["vec_id", "ints", "wide", "sums", "norms"],
                )

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = table.filter((F.size("embedding") == DIMS) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return kept.mapInArrow(tidied(run), "vec_id long, ints array<int>, wide array<string>, sums binary, norms binary")


def nearest(ints: np.ndarray, sums: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many distances were measured."""
    c_sums, c_norms = compressed(centroids)
    bound = (((sums[:, None, :] - c_sums) ** 2) / SEGMENT + (norms[:, None, :] - c_norms) ** 2).sum(2)
    # what rounding may add to a bound, generously
    bound -= 1e-9 * ((sums**2 / SEGMENT + norms**2).sum(1)[:, None] + (c_sums**2 / SEGMENT + c_norms**2).sum(1) + 1)
    rows, first = np.arange(len(ints)), bound.argmin(1)
    best = ((ints - centroids[first]) ** 2).sum(1)
    least = np.full(bound.shape, np.iinfo(np.int64).max)
    least[rows, first] = best
    open_ = bound <= best[:, None]
    open_[rows, first] = False
    i, j = np.nonzero(open_)
    for k in range(0, len(i), 4 * CHUNK):
        a, b = i[k : k + 4 * CHUNK], j[k : k + 4 * CHUNK]
        least[a, b] = ((ints[a] - centroids[b]) ** 2).sum(1)
    cluster = least.argmin(1)  # the smaller number of equal ones
    return cluster, least[rows, cluster], len(ints) + len(i)


def _assigned(batch: pa.RecordBatch, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """Row numbers, components, distances and clusters: rows that fit in 64 bits together, the others one by one."""
    fits = max((abs(c) for row in centroids for c in row), default=0) < NARROW
    narrow = np.flatnonzero(batch.column("ints").is_valid().to_numpy(zero_copy_only=False)) if fits else np.zeros(0, np.int64)
    table = np.array(centroids, np.int64) if fits else None
    for k in range(0, len(narrow), CHUNK):
        at = narrow[k : k + CHUNK]
        part = batch.take(pa.array(at))
        raw = lambda name: np.frombuffer(b"".join(part.column(name).to_pylist()), "<f8").reshape(len(at), -1)
        ints = part.column("ints").flatten().to_numpy().astype(np.int64).reshape(len(at), DIMS)
        cluster, distance, _ = nearest(ints, raw("sums"), raw("norms"), table)
        yield at, ints, distance.tolist(), cluster
    for r in np.setdiff1d(np.arange(len(batch)), narrow):
        ints, wide = batch.column("ints")[r].as_py(), batch.column("wide")[r].as_py()
        v = np.array([int(c) for c in wide] if ints is None else ints, object)
        distances = [int(((v - np.array(c, object)) ** 2).sum()) for c in centroids]
        c = min(range(len(centroids)), key=distances.__getitem__)
        yield np.array([r]), v[None, :], [distances[c]], np.array([c])


def _sums(compressed_: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Vectors in each cluster and their exact componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), object)
        for batch in batches:
            for _, ints, _, cluster in _assigned(batch, centroids):
                for c in np.unique(cluster):
                    own = ints[cluster == c]
                    count[c] += len(own)
                    total[c] += own.sum(0)
        keys, values = [], []
        for c in np.flatnonzero(count):
            keys.append((int(c), -1, 0))
            values.append(int(count[c]))
            for k, x in enumerate(map(int, total[c])):
                limb, sign = 0, -1 if x < 0 else 1
                x = abs(x)
                while x:
                    keys.append((int(c), k, limb))
                    values.append(sign * (x & ((1 << LIMB) - 1)))
                    x, limb = x >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], pa.int32()) for j in range(3)), pa.array(values, pa.int64())], names=["cluster", "component", "limb", "x"])

    parts = compressed_.mapInArrow(tidied(run), "cluster int, component int, limb int, x long")
    out: dict[int, tuple[int, list[int]]] = {}
    # at most clusters x components rows, times the limbs of a component
    rows = parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("x").cast("decimal(28,0)")).alias("x")).collect()
    for r in rows:
        count, total = out.setdefault(r.cluster, (0, [0] * DIMS))
        if r.component < 0:
            out[r.cluster] = (int(r.x), total)
        else:
            total[r.component] += int(r.x) << (LIMB * r.limb)
    return out


def starts(compressed_: DataFrame, clusters: int) -> list[list[int]]:
    """Components of the vectors with the smallest hashes, in the order of those."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = compressed_.select(name.alias("name"), "ints", "wide").orderBy("name", F.asc_nulls_last("ints"), "wide").limit(clusters).collect()
    return [list(r.ints) if r.ints is not None else [int(c) for c in r.wide] for r in first]


def cluster(spark: SparkSession, table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of ``table``."""
    scratch = Scratch(spark, "clusters")
    known = scratch.write(vectors(table), "vectors")
    centroids = starts(known, clusters)
    for _ in range(rounds if centroids else 0):
        for c, (count, total) in _sums(known, centroids).items():
            centroids[c] = [x // count for x in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = np.zeros(len(batch), np.int32), np.zeros(len(batch), object)
            for at, _, d, c in _assigned(batch, centroids):
                number[at], distance[at] = c, d
            fits = [d if d < 2**63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    rows = scratch.write(known.select("vec_id", "ints", "wide", "sums", "norms").mapInArrow(tidied(run), "vec_id long, cluster int, distance long"), "rows")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("known")).collect()
    of = {r.cluster: int(r.s) if r.n == r.known else None for r in sums}
    everything = None if None in of.values() else sum(of.values())
    long = lambda x: x if x is not None and x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, long(x), long(everything), digest[c]) for c, x in of.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row for each cluster


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, read(spark, sf_dir, "embeddings"))


def op12_sql() -> str:
    """Whole numbers of any size are DuckDB's HUGEINT here, so components must stay below some 2 ** 58."""
    part = f"""
  d{{k}} AS (SELECT vec_id, row, v, c, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::HUGEINT AS distance FROM vectors, c{{k}}),
  a{{k}} AS (SELECT vec_id, row, v, c, distance FROM d{{k}} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c) = 1)"""
    step = f"""
  s{{k}} AS (SELECT c, i, floor_of AS x FROM (
    SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_of FROM (SELECT c, unnest(v) AS x, unnest(range(1, {DIMS + 1})) AS i FROM a{{k}}) GROUP BY c, i)),
  m{{k}} AS (SELECT c, list(x ORDER BY i) AS w FROM s{{k}} GROUP BY c),
  c{{n}} AS (SELECT c{{k}}.c, coalesce(m{{k}}.w, c{{k}}.w) AS w FROM c{{k}} LEFT JOIN m{{k}} ON m{{k}}.c = c{{k}}.c)"""
    rounds = ",".join(part.format(k=k) + "," + step.format(k=k, n=k + 1) for k in range(ROUNDS))
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({GRAIN} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
  c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS w FROM vectors ORDER BY c LIMIT {CLUSTERS}),
{rounds},{part.format(k=ROUNDS)}
SELECT vec_id, a{ROUNDS}.c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY a{ROUNDS}.c))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = a{ROUNDS}.c"""


QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
SQL = {"op12_centroid_clusters": op12_sql()}
