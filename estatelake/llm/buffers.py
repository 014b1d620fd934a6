"""Texts of an Arrow batch as one byte array, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
#: Bytes after which a text may be cut, by default: white space.
BLANK = np.arange(256) <= 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    column = column.fill_null("").cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, dtype=np.uint8), offsets


def _cut(data: np.ndarray, cut: int, end: int, piece: int, after: tuple[np.ndarray, ...]) -> int:
    """Where to cut at ``cut`` or beyond: after a byte of the first kind within another ``piece``, or else of the next one,
    the last kind up to the text's end. Nothing is ever cut in its middle."""
    for i, kind in enumerate(after):
        last = i == len(after) - 1
        for at in range(cut, end if last else min(end, cut + piece), piece):
            found = np.flatnonzero(kind[data[at : min(end, at + piece)]])
            if len(found):
                return at + int(found[0]) + 1
    return end


def pieces(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE, after: tuple[np.ndarray, ...] = (BLANK,)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, starts, ends) of runs of about ``piece`` bytes in all; a longer text comes in several pieces, each cut
    after a byte that ``after`` names (tables of 256, the most wanted first)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + piece, side="right")) - 1
        if j > i:
            j = min(j, n)
            yield np.arange(i, j), offsets[i:j], offsets[i + 1 : j + 1]
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            cut = min(end, at + piece)
            if cut < end:
                cut = _cut(data, cut - 1, end, piece, after)
            yield np.array([i]), np.array([at]), np.array([cut])
            at = cut
        i += 1
