"""Small helpers for functions that receive a bounded group as an Arrow table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix, one row per entry."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1) if len(whole) else np.zeros((0, 0))


def matrix_list(matrix: np.ndarray) -> pa.Array:
    """Reverse of :func:`list_matrix`."""
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), pa.float64()))
