"""64-bit hashes of words and word sequences, for whole Arrow batches at a time.

A word's hash is a polynomial over its UTF-8 bytes modulo 2^64, taken from running sums over the
batch and mixed; it is the same whatever batch or task a text lies in. Words are runs of anything
but ASCII white space, with A-Z lowered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are hashed in runs of about so many bytes.
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Value of each byte (A-Z as a-z), and whether it is white space."""
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    code = np.arange(256, dtype=np.uint64)
    code[65:91] += np.uint64(32)
    return mix(code + np.uint64(1)), space


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 places where its values begin and end; null: empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[starts[0]:starts[-1]] if data is not None else np.empty(0, np.uint8)
    return data, starts - starts[0]


def hash_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of each text."""
    values, space = byte_tables()
    blank = space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    before[1:] = blank[:-1]
    after[:-1] = blank[1:]
    first = np.flatnonzero(~blank & (before | edge[:-1]))
    end = np.flatnonzero(~blank & (after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(first, starts))
    size = 1 << max(10, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers(int(MULTIPLIER), size)[:len(data)], out=sums[1:])
    hashes = (sums[end] - sums[first]) * powers(int(INVERSE), size)[first]
    return mix(hashes + (end - first).astype(np.uint64)), counts


def hashed_texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words per row) for runs of rows of bounded size."""
    data, starts = bytes_of(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, end, *hash_words(data[starts[row]:starts[end]], starts[row:end + 1] - starts[row])
        row = end


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words within a text and the number of windows per text.

    A text of fewer words has one window, all its words; one without words has none.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(len(words), dtype=np.uint64)
    inside = np.zeros(len(words), dtype=np.uint64)
    for k in range(width):
        factor = mix(np.array([k + 1], dtype=np.uint64))[0] | np.uint64(1)
        same = np.zeros(len(words), dtype=bool)
        same[:len(words) - k] = text[k:] == text[:len(words) - k] if k else True
        total[:len(words) - k][same[:len(words) - k]] += words[k:][same[:len(words) - k]] * factor
        inside += same
    first = np.zeros(len(words), dtype=bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    whole = (inside == width) | first
    windows = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    return mix(total + inside * MULTIPLIER)[whole], windows
