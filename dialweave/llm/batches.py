"""Arrow batches in parts that a task can turn into Python objects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a column handled at a time; a longer value is taken alone.
PART = 1 << 20


def cuts(column: pa.Array, most: int = PART) -> Iterator[tuple[int, int]]:
    """(first, length) of neighbouring values of about `most` bytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield start, end - start
        start = end


def parts(batches: Iterable[pa.RecordBatch], column: str, most: int = PART) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, length in cuts(batch.column(column), most):
            yield batch.slice(start, length)
