"""Files that stopped growing, and sources that fell silent, as state with timers.

A poll is a row: key, time, size. A key is settled when two polls in a row saw the same size (above
zero), and is told once. A key is silent when no poll came for ``idle`` seconds: a timer on event time
tells it when the watermark passes, or the next poll does if that comes first; with it the state goes, so what
is kept grows with the keys that are polled and not with those that ever were. A key that comes back
starts anew.

Polls of a micro-batch are taken in the order of time; one older than the newest seen of its key is left
out, as is one without a time or size. A start from the checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds without a heartbeat after which a source is silent (fixed value).
IDLE = 12.0
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Polls(StatefulProcessor):
    def __init__(self, idle: float):
        self.idle = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, size long, told boolean")

    def rows(self, key: tuple, found: list[tuple[str, int, int]]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame({"key": [key[0]] * len(found), "kind": [k for k, _, _ in found], "at": pd.to_datetime([a for _, a, _ in found], unit="ms"), "size": [s for _, _, s in found]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now, found = self.last.get() if self.last.exists() else None, []
        for at, size in sorted((int(r.ms), int(r.size)) for part in rows for r in part[["ms", "size"]].dropna().itertuples(index=False)):
            if now and at < now[0]:
                continue
            if now and at - now[0] > self.idle:
                found.append(("silent", now[0] + self.idle, now[1]))
                now = None
            settled = bool(now) and not now[2] and size > 0 and size == now[1]
            if settled:
                found.append(("settled", at, size))
            now = (at, size, bool(now and now[2]) or settled)
        if now:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now[0] + self.idle)
            self.last.update(now)
        yield from self.rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.last.exists():
            at, size, _ = self.last.get()
            self.last.clear()
            yield from self.rows(key, [("silent", at + self.idle, size)])

    def close(self) -> None:
        pass


def told(polls: DataFrame, key: str, at: str, size: Column, idle: float = IDLE, late: str = "1 minute") -> DataFrame:
    """key, kind ('settled', 'silent'), at, size of a stream of polls. Needs the RocksDB state store (``PROVIDER``)."""
    kind = polls.schema[key].dataType.simpleString()
    rows = polls.withWatermark(at, late).select(F.col(key).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("ms"), size.cast("long").alias("size"))
    out = f"key {kind}, kind string, at timestamp, size long"
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Polls(idle), outputStructType=out, outputMode="append", timeMode="EventTime")


def told_of(polls: DataFrame, key: str, at: str, size: Column, idle: float = IDLE) -> DataFrame:
    """The same of a table that holds all polls; the last poll of every key counts as followed by silence."""
    w = Window.partitionBy("key").orderBy("ms", "size")
    rows = polls.select(F.col(key).alias("key"), F.unix_millis(at).alias("ms"), size.cast("long").alias("size")).dropna()
    gap = F.lead("ms").over(w) - F.col("ms")
    seen = rows.withColumn("_new", F.coalesce(F.col("ms") - F.lag("ms").over(w) > int(idle * 1000), F.lit(True)).cast("int")).withColumn("_gap", gap).withColumn("_before", F.lag("size").over(w))
    parts = seen.withColumn("_part", F.sum("_new").over(w))
    same = parts.filter((F.col("_new") == 0) & (F.col("size") == F.col("_before")) & (F.col("size") > 0))
    settled = same.groupBy("key", "_part").agg(F.min(F.struct("ms", "size")).alias("m")).select("key", F.lit("settled").alias("kind"), F.timestamp_millis("m.ms").alias("at"), F.col("m.size").alias("size"))
    quiet = parts.filter(F.coalesce(F.col("_gap") > int(idle * 1000), F.lit(True))).select("key", F.lit("silent").alias("kind"), F.timestamp_millis(F.col("ms") + int(idle * 1000)).alias("at"), "size")
    return settled.unionByName(quiet)
