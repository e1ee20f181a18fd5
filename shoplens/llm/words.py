"""Runs of bytes as words, without a Python object for each occurrence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column's texts in a row, and their borders (one
    more than there are texts; a null text is empty)."""
    col = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = col.buffers()
    borders = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[borders[0]:borders[-1]], borders - borders[0]


def runs_between(kind: np.ndarray, borders: np.ndarray, single: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the maximal runs of one kind other than 0, none
    across a border; those of kind `single` are cut into runs of one."""
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    if single is not None:
        new |= kind == single
    new[borders[borders < len(kind)]] = True
    last = np.ones(len(kind), bool)
    last[:-1] = new[1:]
    there = kind != 0
    return np.flatnonzero(new & there), np.flatnonzero(last & there)


def distinct_runs(raw: np.ndarray, borders: np.ndarray, kind: np.ndarray, single: int | None = None):
    """The runs (see above) of the bytes `raw`: each occurrence's number among
    the distinct runs, the distinct runs (an Arrow binary array), and for each
    border the occurrences before it."""
    starts, ends = runs_between(kind, borders, single)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=offsets[1:])
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(offsets), pa.py_buffer(raw[kind != 0])]).dictionary_encode()
    return (runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), runs.dictionary,
            np.searchsorted(starts, borders))
