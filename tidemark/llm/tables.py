"""Reading tables, keeping intermediate results, and leaving workers tidy."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "read", "shared_dir", "tidied"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for a task; when it ends, what it held goes back to the machine, as its worker lives on idle."""

    @functools.wraps(run)
    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux keeps what is freed
                trim(0)

    return task
