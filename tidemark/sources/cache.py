"""Results kept by entity and computed again only where their input changed.

An entity's input has a signature: row digests added up, so neither order nor files matter and a
hot entity costs four numbers. A run computes entities whose signature (or the computation's version) is
not the stored one, takes the others from the store, and stores what is final. Stored entities lie in
buckets by hash; a run rewrites the buckets it touches and leaves the others alone.

Results are written before signatures: a run that dies in between is done again. One run at a time
writes to a store.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMBS, DIGITS = 4, 14


def signatures(rows: DataFrame, key: list[str], version: str = "") -> DataFrame:
    """key and ``signature`` of each entity's rows: of all columns, whatever the rows' order."""
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) if "map" not in t else F.to_json(c).alias(c) for c, t in rows.dtypes])), 256)
    limb = lambda k: F.conv(F.substring("_d", 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(18,0)")
    sums = rows.withColumn("_d", digest).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(limb(k)).cast("string").alias(f"_s{k}") for k in range(LIMBS)))
    return sums.select(*key, F.sha2(F.concat_ws("/", F.lit(version), F.col("_n").cast("string"), *(F.col(f"_s{k}") for k in range(LIMBS))), 256).alias("signature"))


@dataclass
class Store:
    """A folder with the results and signatures of entities. ``version`` names the computation: a new one makes all anew."""

    spark: SparkSession
    path: str
    key: list[str]
    version: str = ""
    buckets: int = 64

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def _replace(self, rows: DataFrame, name: str) -> None:
        rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/{name}")

    def run(self, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], final: Column | None = None) -> DataFrame:
        """``compute`` of the inputs, with ``recomputed``. ``final``: of a result row, whether its entity may be stored (all its rows must be).

        ``compute`` keeps the key columns and makes an entity's rows from that entity's inputs alone.
        """
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket")
        same = lambda a, b: functools.reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in self.key))
        types = {f.name: f.dataType.simpleString() for f in inputs.schema.fields}
        now = signatures(inputs, self.key, self.version)
        index = self._read("signatures", ", ".join([*(f"{k} {types[k]}" for k in self.key), "signature string, _bucket int"]))
        hit = now.join(index.withColumnsRenamed({k: f"_{k}" for k in self.key}).withColumnRenamed("signature", "_signature").drop("_bucket"), functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key)), "left")
        marked = hit.select(*self.key, "signature", F.coalesce(F.col("signature") == F.col("_signature"), F.lit(False)).alias("known"))
        work = f"{self.path}/work"
        marked.write.mode("overwrite").parquet(f"{work}/marked")
        marked = self.spark.read.schema(marked.schema).parquet(f"{work}/marked")
        changed, known = marked.filter("NOT known").select(*self.key), marked.filter("known").select(*self.key, "signature")
        fresh = compute(inputs.join(changed.alias("c"), same(inputs, changed), "left_semi"))
        fresh.write.mode("overwrite").parquet(f"{work}/fresh")
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{work}/fresh")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields)
        # a stored row names the signature it was made from: what an entity had before is never taken for its result
        stored = self._read("results", f"{kinds}, _signature string, _bucket int")
        of = lambda rows: rows.join(known, same(rows, known) & (rows["_signature"] == known["signature"]), "left_semi")
        kept = of(stored)

        # entities that are stored now: final ones, and those without a result
        open_ = fresh.filter(~F.coalesce(final, F.lit(False))).select(*self.key).distinct() if final is not None else None
        sealed = changed if open_ is None else changed.join(open_, same(changed, open_), "left_anti")
        touched = changed.select(bucket).distinct()
        old = kept.join(F.broadcast(touched), "_bucket", "left_semi")  # at most ``buckets`` rows
        signed = marked.join(sealed, same(marked, sealed), "left_semi").select(*(F.col(k).alias(f"_{k}") for k in self.key), F.col("signature").alias("_signature"))
        named = fresh.join(signed, functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key))).select(*fresh.columns, "_signature")
        both = named.withColumn("_bucket", bucket).unionByName(old.select(*fresh.columns, "_signature", "_bucket"))
        # what is written is read from the same folder, so it goes aside first
        both.write.mode("overwrite").parquet(f"{work}/results")
        self._replace(self.spark.read.schema(both.schema).parquet(f"{work}/results"), "results")
        mark = marked.join(sealed, same(marked, sealed), "left_semi").unionByName(marked.filter("known").withColumn("_b", bucket).join(F.broadcast(touched), F.col("_b") == touched["_bucket"], "left_semi").drop("_b"))
        self._replace(mark.drop("known").withColumn("_bucket", bucket), "signatures")
        out = of(self._read("results", f"{kinds}, _signature string, _bucket int")).select(*fresh.columns).withColumn("recomputed", F.lit(False))
        return out.unionByName(fresh.withColumn("recomputed", F.lit(True)))
