"""Words of whole Arrow batches as Arrow arrays: cut by tables of bytes, told apart exactly.

All separators are ASCII characters, so texts are cut as UTF-8 bytes. A word is a run of bytes
that are no separators; words of one batch are numbered by their distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from statewave.llm.hashing import bytes_of

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def byte_set(*codes: int | range) -> np.ndarray:
    """A table of 256 flags, set for the given bytes."""
    flags = np.zeros(256, dtype=bool)
    for c in codes:
        flags[np.array(c)] = True
    return flags


class Words(NamedTuple):
    code: np.ndarray
    """Number of each word's value, in text order."""
    values: pa.Array
    """The distinct words (large binary)."""
    counts: np.ndarray
    """Words of each text."""
    piece: np.ndarray
    """Number of each word's piece: it changes between texts and at piece separators."""


def joined(data: np.ndarray, first: np.ndarray, end: np.ndarray, inside: np.ndarray) -> pa.Array:
    """Binary values data[first:end]; ``inside`` flags the bytes that belong to any of them."""
    offsets = np.zeros(len(first) + 1, dtype=np.int64)
    np.cumsum(end - first, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def cut_words(data: np.ndarray, starts: np.ndarray, breaks: np.ndarray, piece_breaks: np.ndarray | None = None,
              ends_after: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words of texts that lie one after the other in ``data``, beginning at ``starts``.

    A word also ends between a byte of the first and one of the second table of ``ends_after``.
    """
    blank = breaks[data] if piece_breaks is None else (breaks | piece_breaks)[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    edge[1:-1] |= blank[:-1]
    edge[:-1] |= blank
    if ends_after is not None:
        edge[1:-1] |= ends_after[0][data[:-1]] & ends_after[1][data[1:]]
    edge[-1:] = True
    inside = ~blank
    first = np.flatnonzero(edge[:-1] & inside)
    end = np.flatnonzero(edge[1:] & inside) + 1
    counts = np.diff(np.searchsorted(first, starts))
    text = np.repeat(np.arange(len(counts)), counts)
    piece = text
    if piece_breaks is not None and len(first):
        piece = text + np.cumsum(piece_breaks[data])[first]
    words = joined(data, first, end, inside).dictionary_encode()
    return Words(words.indices.to_numpy(), words.dictionary, counts, piece)


def cut_column(column: pa.Array, chunk_bytes: int, breaks: np.ndarray, lower: bool = True, **more) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for runs of rows of about ``chunk_bytes``; null counts as empty."""
    data, starts = bytes_of(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + chunk_bytes, side="right")) - 1)
        part = data[starts[row]:starts[end]]
        yield row, end, cut_words(LOWERED[part] if lower else part, starts[row:end + 1] - starts[row], breaks, **more)
        row = end
