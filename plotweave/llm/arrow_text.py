"""Texts of Arrow batches as numpy arrays of bytes or code points."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2_000_000  # bytes of text that are worked on at once; a longer text is a chunk of its own


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Memory that this worker has freed goes back to the system, as an idle worker's share counts for its executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)(0)  # glibc has it


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``size`` bytes of text; no row is split or left out."""
    for batch in batches:
        if batch.num_rows:
            lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths.astype(np.int64))
            start, before = 0, 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
                yield batch.slice(start, stop - start)
                start, before = stop, int(ends[stop - 1])
        del batch  # before the next one is read
    give_back()


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets of each text among them."""
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), starts[offsets]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
