"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def trim() -> None:
    """Give freed memory back, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_merge(right: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``right`` with a broadcast hint if its counted rows stay under ``limit``
    bytes; beyond that Spark joins by shuffle and AQE splits hot keys."""
    return F.broadcast(right) if rows * row_bytes <= limit else right


def set_aside(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The ``wanted`` columns that ``df`` has and all its others in one struct, so that
    none of their names meets one that an operator makes."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in wanted]
    kept = [c for c in df.columns if c in wanted]
    return df.select(*kept, F.struct(F.struct(*others) if others else F.lit(0)).alias("set_aside"))


def put_back(df: DataFrame, like: DataFrame, wanted: list[str]) -> DataFrame:
    """``df``, made from ``set_aside(like, wanted)``, with the columns of ``like``."""
    return df.select(*[F.col(c) if c in wanted else F.col(f"set_aside.col1.`{c}`") for c in like.columns])


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in row ranges of about ``size`` bytes of text, with the text as
    a null-free string array (null is empty); one longer text is a slice alone."""
    import numpy as np
    import pyarrow.compute as pc

    text = batch.column(column).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(text):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start), text.slice(start, stop - start)
        start = stop
    trim()
