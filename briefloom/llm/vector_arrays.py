"""Vectors of Arrow list columns as numpy matrices. No Spark code: a small helper for ``mapInArrow`` functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) per length of the vectors in ``column``, shortest first; null vectors and those with a null or non-finite entry are left out."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    sizes = np.asarray(pc.list_value_length(column).fill_null(0))
    ends = np.cumsum(sizes)
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    good = (bad[ends] == bad[ends - sizes]) & np.asarray(pc.is_valid(column))
    for size in np.unique(sizes[good]).tolist():
        at = np.flatnonzero(good & (sizes == size))
        yield at, values[(ends - sizes)[at][:, None] + np.arange(size)]
