"""Sharding: a Feistel permutation of global row numbers, walked until it lands inside the table.

Every row gets its number in the order of ``doc_id``. A keyed permutation of ``0 .. n-1``
maps that number to a place; ``place % shards`` is the shard and ``place // shards`` the slot,
so shard sizes differ by one row at most and both are computable from the row number alone
(and the row number from them). Nothing but a digest row (id, size, checksum) is ever moved.

Defined results. Null text: no bytes, checksum 0. Null ids are numbered first. Rows with equal
id, size and checksum are interchangeable and take neighbouring numbers. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import Scratch, read

ROUND_KEYS = (0x2545F491, 0x1B873593, 0x4CF5AD43, 0x38495AB5)
SHARDS = 24
ORDER = ("doc_id", "text_crc32", "size")


def half_bits(n: int) -> int:
    """Bits of one half of the permuted domain, the smallest ``4 ** bits >= n``."""
    bits = 1
    while 4**bits < n:
        bits += 1
    return bits


def _mix(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    # every product stays below 2 ** 63, so signed 64-bit SQL computes the same
    x = (x + key) & 0x7FFFFFFF
    x = (x * 0x5BD1E995) & 0x7FFFFFFF
    x = x ^ (x >> 15)
    x = (x * 0x2C1B3C6D) & 0x7FFFFFFF
    return (x ^ (x >> 13)) & mask


def permute(rows: np.ndarray, n: int, keys: tuple[int, ...] = ROUND_KEYS, inverse: bool = False) -> np.ndarray:
    """Places of row numbers (or, inverted, row numbers of places) among ``0 .. n-1``."""
    bits = half_bits(n)
    if bits > 31:
        raise ValueError("tables of over 4 ** 31 rows need wider halves")
    mask, out = (1 << bits) - 1, rows.astype(np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ _mix(left, key, mask), left
            else:
                left, right = right, left ^ _mix(right, key, mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= n]
    return out


def number_rows(spark: SparkSession, rows: DataFrame, order: tuple[str, ...], scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` 0..n-1 in a total order, without a single-task window.

    A range shuffle sorts the rows, each task numbers its own, and the written table says how
    many rows every task had; that list has one entry a task.
    """
    sorted_ = scratch.write(
        rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "sorted",
    )
    starts, n = [], 0
    for part, count in sorted(sorted_.groupBy("part").count().collect()):
        starts.append((part, n))
        n += count
    offsets = spark.createDataFrame(starts, "part int, start long")
    # one row for each task of the sort, so the broadcast is bounded by the task count
    return sorted_.join(F.broadcast(offsets), "part").withColumn("row_number", F.col("start") + F.col("at")).drop("part", "at", "start"), n


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, keys: tuple[int, ...] = ROUND_KEYS) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row of ``docs``."""
    digest = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    numbered, n = number_rows(spark, digest, ORDER, Scratch(spark, "sharding"))

    @F.pandas_udf("long")
    def place(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in rows:
            yield pd.Series(permute(batch.to_numpy(), n, keys))

    placed = numbered.withColumn("place", place("row_number"))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
    )


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op7_sql(shards: int = SHARDS, keys: tuple[int, ...] = ROUND_KEYS) -> str:
    """The same numbering, permutation (by a recursive walk) and checksum (by a bit rule)."""
    mix = lambda x, k: (
        f"(SELECT c FROM (SELECT xor(b, b >> 13) & mask AS c FROM (SELECT (xor(a, a >> 15) * {0x2C1B3C6D}) & {0x7FFFFFFF} AS b "
        f"FROM (SELECT ((({x} + {k}) & {0x7FFFFFFF}) * {0x5BD1E995}) & {0x7FFFFFFF} AS a))))"
    )
    step = "SELECT rn, n, bits, mask, place >> bits AS l0, place & mask AS r0 FROM walk WHERE NOT done"
    for i, k in enumerate(keys):
        step = f"SELECT rn, n, bits, mask, r{i} AS l{i + 1}, xor(l{i}, {mix(f'r{i}', k)}) AS r{i + 1} FROM ({step})"
    e = len(keys)
    return f"""
WITH RECURSIVE digest AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 8)::BIGINT AS size,
         coalesce(text, '') AS body
  FROM documents),
codes AS (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
    FROM (SELECT unnest(range(256)) AS i))),
summed AS (
  SELECT doc_id, size,
    CASE WHEN body = '' THEN 0 ELSE xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(body))::BIGINT + 1), lambda i: ('0x' || substr(h, (2 * i - 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END::BIGINT AS text_crc32
  FROM (SELECT *, hex(encode(body)) AS h FROM digest), codes),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number, count(*) OVER () AS n FROM summed),
sized AS (SELECT *, greatest(1, ceil(log2(n) / 2 - 1e-12))::BIGINT AS bits FROM numbered),
walk AS (
  SELECT row_number AS rn, n, bits, (1::BIGINT << bits) - 1 AS mask, row_number::BIGINT AS place, false AS done FROM sized
  UNION ALL
  SELECT rn, n, bits, mask, (l{e} << bits) | r{e} AS place, ((l{e} << bits) | r{e}) < n AS done FROM ({step}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {shards})::INTEGER AS shard, (place // {shards})::BIGINT AS slot,
       NULL::INTEGER AS grown_shard, row_number::BIGINT AS row_number
FROM sized JOIN walk ON rn = row_number AND done"""


QUERIES = {"op7_shards": op7_shards}
