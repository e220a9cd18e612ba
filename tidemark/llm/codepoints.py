"""Arrow text as numpy code points and back, a whole column at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column in a row, and the offsets of its rows; a null has no code points."""
    if column.null_count:
        column = column.fill_null("")
    column = pa.concat_arrays([column.cast(pa.large_string())])
    if not len(column):
        return np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return codes, chars[ends - ends[0]]


def from_codes(codes: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The string column whose rows are codes[offsets[i]:offsets[i + 1]]; `null` marks rows that are null."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[offsets].astype(np.int64)
    column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data))
    if null is not None and null.any():
        column = pa.array(np.where(null, None, np.array(column.to_pylist(), dtype=object)), pa.large_string())
    return column.cast(pa.string())


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row of each position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def rows_with(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a position that is marked."""
    sums = np.concatenate([[0], np.cumsum(mask)])
    return np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])


def only_rows(codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of just these rows, and their offsets."""
    size = offsets[rows + 1] - offsets[rows]
    ends = np.concatenate([[0], np.cumsum(size)])
    return codes[np.repeat(offsets[rows] - ends[:-1], size) + np.arange(ends[-1])], ends
