"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.staging import clean, cut, drop, shared_dir

__all__ = ["NO_ID", "bytes_of", "clean", "cut", "drop", "free_name", "give_back", "hold", "mapped", "others", "shared_dir", "slices", "table", "text_of"]

#: Stands for a missing id inside an operator, so that keys join and order.
NO_ID = -(2**63)


def text_of(col: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Free memory of this process goes to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers, which wait for other tasks beside the
    executor, keep no free memory after theirs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


_held: dict[tuple, Any] = {}


def hold(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker under ``key``.

    Spark hands a worker from one operator to the next; it keeps the large
    tables of the last one only, so they don't add up over a pipeline, and what
    was freed goes back to the system.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        give_back()
        _held[key] = make()
    return _held[key]


def slices(lengths: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """[a, b) of neighbouring rows of about ``size`` bytes, or one longer row."""
    ends = np.cumsum(lengths, dtype=np.int64)
    at, done = 0, 0
    while at < len(ends):
        to = min(len(ends), int(np.searchsorted(ends, done + size)) + 1)
        yield at, to
        at, done = to, int(ends[to - 1])


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but for those named; as in Spark, case doesn't matter."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts (null: empty) in one array, and where each begins; one end more."""
    texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]
