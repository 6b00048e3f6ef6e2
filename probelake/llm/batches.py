"""Bounded pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PIECE_BYTES = 4_000_000
BATCH_BYTES = 8_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def hold_batches(spark: SparkSession) -> None:
    """Limit the batches that go to Python by bytes: ten thousand rows of long texts or large sets are more than a task should hold.

    A limit in the configuration of the application stays.
    """
    if not spark.sparkContext.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` bytes of a text column (one row at least)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(a, b - a)
            a = b
