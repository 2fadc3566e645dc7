"""Moving between Arrow list columns and NumPy matrices inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """One float array per row of a list column (views on the Arrow buffer)."""
    values = column.values.to_numpy(zero_copy_only=False)
    bounds = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """All rows of an equal-length list column as one ``rows x width`` matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def list_column(rows: list[np.ndarray]) -> pa.Array:
    """Float list column from one array per row."""
    bounds = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=bounds[1:])
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.asarray(flat, dtype=float)))


def matrix_column(matrix: np.ndarray) -> pa.Array:
    """Float list column from the rows of a matrix."""
    n, width = matrix.shape
    bounds = np.arange(n + 1, dtype=np.int32) * width
    flat = np.ascontiguousarray(matrix, dtype=float).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
