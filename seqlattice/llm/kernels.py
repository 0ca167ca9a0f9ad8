"""Numpy helpers over Arrow batches of texts: all texts of a batch lie in one array, so a window costs no Python step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[65:91] = _LETTERS[97:123] = np.arange(65, 91)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each text starts; null is as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)), offsets - offsets[0]


def residue_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The upper-cased letters of all texts of a column, and where each text's letters start."""
    raw, starts = joined(column)
    codes = _LETTERS[raw]
    kept = codes > 0
    return codes[kept], np.concatenate(([0], np.cumsum(kept)))[starts]


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(codes: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every window of ``length`` codes, built from windows of the powers of two in ``length``."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    part = mixed(codes.astype(np.uint64), seed)
    whole, done, size = None, 0, 1
    while True:
        if length & size:
            if whole is None:
                whole = part
            else:
                n = len(codes) - done - size + 1
                whole = whole[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + n]
            done += size
        if size * 2 > length:
            break
        part = part[: len(part) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    return mixed(whole, seed + 1)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    if len(values) < width:
        return values[:0]
    least, size = values, 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - size : width - size + n])


def whole_windows(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all windows of ``length`` that lie in one text, and the number of that text."""
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(text))
    inside = at + length <= starts[1:][text]
    return at[inside], text[inside]
