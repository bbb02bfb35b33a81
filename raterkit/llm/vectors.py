"""Numpy matrices from list columns and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column as floats, padded with zeros to ``dims``."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out, row = np.zeros((len(column), dims)), 0
    for part in parts:
        lengths = part.value_lengths().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(row, row + len(part)), lengths)
        places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, places] = part.flatten().to_numpy(zero_copy_only=False)
        row += len(part)
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))
