"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

__all__ = ["bins", "document_key", "release", "small_batches", "stored", "text_slices", "without_clash"]

#: Rows of one Arrow batch. Texts can be very long, so batches stay small.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes: one batch is what a Python worker holds of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def bins(spark: SparkSession) -> int:
    """How many bins packed keys are dealt to: the session's number of shuffle partitions, which its owner sizes with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def document_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """Tells rows that share an id (or have none) apart by their text; equal rows share the key and the result."""
    return F.xxhash64(F.col(id_col), F.col(text))


def without_clash(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator is about to add (its own result wins)."""
    return df.drop(*[n for n in names if n in df.columns])


def text_slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A string column as UTF-8 bytes, in runs of whole rows of about ``limit`` bytes.

    Yields (first row, row after the last, bytes, offsets); a null counts as an empty text. One text longer
    than the limit is a run of its own.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], (offsets[lo:hi + 1] - offsets[lo])
        lo = hi
