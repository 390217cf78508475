"""Arrow batches in small parts, and freed memory given back to the system.

Python workers are reused from task to task, and allocators keep what a large batch
once needed. Work on parts of bounded size keeps the need of a task small; returning
freed pages keeps idle workers small. An executor's memory is then flat over the
stages of a long application.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 18


@functools.cache
def _trim():
    """The C library's ``malloc_trim`` where there is one."""
    try:
        return ctypes.CDLL(ctypes.util.find_library("c")).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """Return freed memory of Arrow's and the C library's allocators to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_parts(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = PART_BYTES, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, as slices of about ``limit`` bytes of text (one longer text is a slice of its own) and at most ``rows`` rows."""
    try:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size, dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                before = ends[start] - size[start]
                stop = min(max(int(np.searchsorted(ends, before + limit, side="right")), start + 1), start + rows, batch.num_rows)
                yield batch.slice(start, stop - start)
                start = stop
            give_back()
    finally:
        give_back()


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; nulls are empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()
