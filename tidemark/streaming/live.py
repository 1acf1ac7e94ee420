"""Structured Streaming over event tables: change-only rows, sliding failure counts, settled files.

Every query can drain what there is (``availableNow``) and be started again from its checkpoint.
State is one small row per key, or windows that a watermark closes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def changes(events: DataFrame, key: str, at: str, watched: str, order: str) -> DataFrame:
    """Rows whose watched value differs from the key's previous one; the state is that value.

    Rows of a micro-batch are taken in the order of time. A row from before the newest one of an
    earlier micro-batch, or without a time, can no longer change what was sent: it is passed on
    with ``late`` set and ``old`` NULL, whatever its value, so it can be counted or put right later.
    """
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"{key} {fields[key]}, {at} {fields[at]}, {order} {fields[order]}, old string, new string, late boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, newest = state.get if state.exists else (None, -1)
        rows: list[dict[str, Any]] = []
        for r in pd.concat(list(batches)).sort_values([at, order]).to_dict("records"):
            row = {key: k[0], at: r[at], order: r[order], "new": r[watched]}
            micros = None if pd.isna(r[at]) else pd.Timestamp(r[at]).value // 1000
            if micros is None or micros < newest:
                rows.append(row | {"old": None, "late": True})
                continue
            newest = micros
            if r[watched] != last:
                rows.append(row | {"old": last, "late": False})
                last = r[watched]
        state.update((last, newest))
        if rows:
            yield pd.DataFrame(rows, columns=[key, at, order, "old", "new", "late"])

    return events.groupBy(key).applyInPandasWithState(step, out, "last string, newest long", "append", GroupStateTimeout.NoTimeout)


def failures(events: DataFrame, key: str, at: str, on: str, window: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts of ``on`` rows in sliding windows; a window is final once the watermark has passed it."""
    return events.filter(on).withWatermark(at, late).groupBy(key, F.window(at, window, slide)).agg(F.count(F.lit(1)).alias("n"))


def run_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain the source into Parquet files under ``path``; exactly once per checkpoint."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
