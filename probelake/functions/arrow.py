"""Array columns of Arrow batches as matrices, without a Python object per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column: pa.Array) -> np.ndarray:
    """(rows, width) view of a list<double> column whose rows are equally long and not null."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1)


def from_matrix(m: np.ndarray) -> pa.Array:
    """A list<double> column from the rows of a matrix."""
    m = np.ascontiguousarray(m, dtype=np.float64)
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.shape[1] else np.zeros(len(m) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))
