"""Small helpers shared by the document operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and \x09-\x0D, the separators of a word.
BLANKS = " \t\n\x0b\x0c\r"
#: Texts handed to numpy at a time inside a task, in bytes.
SLICE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; no words for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def worker_cache(name: str, make):
    """An object kept for the life of the Python worker process.

    Task functions are pickled by value, so their module globals are new in
    every task; what is costly to build hangs on ``sys`` instead."""
    store = sys.__dict__.setdefault("_stepwise_worker_cache", {})
    if name not in store:
        store[name] = make()
    return store[name]


def release() -> None:
    """Hand freed memory back to the system: Python workers live on for later
    stages, and what their allocators hold back counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one slice stay near ``limit`` bytes
    (a slice has at least one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        release()


def held_out(id_col: Column) -> Column:
    """True for rows kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a model of bounded size; call the result inside a task to read it.

    Pickled with its class by value, and unpickled once per worker process,
    which keeps the last few models."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    name = uuid.uuid4().hex

    def get() -> Any:
        models = worker_cache("models", dict)
        if name not in models:
            while len(models) >= 4:
                models.pop(next(iter(models)))
            models[name] = cloudpickle.loads(sent.value)
        return models[name]

    return get
