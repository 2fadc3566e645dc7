"""Elias-Fano lists: sorted 64-bit numbers in little more than their information content.

The low bits of each number are stored as they are, in whole bytes; the high bits as a bit vector
with a one per number and a zero per step of the high part. Counts of zeros before every 64 bits
make finding a high part's range a search in them. All arrays lie in one memory-mapped file.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Where the k-th zero of a byte lies, bits from the lowest on; 8 if there is none.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
ZEROS = (8 - BYTE_BITS.sum(axis=1)).astype(np.int64)
ZERO_PLACE = np.array([[*np.flatnonzero(row == 0), *[8] * 8][:8] for row in BYTE_BITS])
#: Numbers that are looked up together: what a search keeps is several times their size.
AT_A_TIME = 1 << 16


class Levels:
    """A file of arrays, mapped into memory; it goes when the object does."""

    def __init__(self):
        self.file = tempfile.TemporaryFile(prefix="trie-")

    def put(self, array: np.ndarray) -> np.ndarray:
        if not array.size:
            return array
        offset = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(array).tobytes())
        self.file.flush()
        return np.memmap(self.file, dtype=array.dtype, mode="r", offset=offset, shape=array.shape)


class EliasFano:
    """``values``: sorted and distinct, as unsigned 64-bit numbers."""

    def __init__(self, values: np.ndarray, levels: Levels):
        self.n = len(values)
        if not self.n:
            return
        span = int(values[-1]) // self.n
        self.low_bytes = min(7, max(1, -(-span.bit_length() // 8)))
        self.low_bits = np.uint64(8 * self.low_bytes)
        low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.low_bytes]
        high = (values >> self.low_bits).astype(np.int64)
        self.top = int(high[-1])
        bits = np.zeros(-(-(self.n + self.top + 2) // 64) * 64, dtype=np.uint8)
        bits[high + np.arange(self.n)] = 1
        upper = np.packbits(bits, bitorder="little")
        zeros = ZEROS[upper].reshape(-1, 8).sum(axis=1)
        self.low = levels.put(low)
        self.upper = levels.put(upper)
        self.zeros = levels.put(np.concatenate([[0], np.cumsum(zeros)[:-1]]).astype(np.int64))

    def bucket_start(self, high: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below ``high``: what stands before its zero, less zeros."""
        k = np.maximum(high - 1, 0)  # the k-th zero ends the bucket before
        word = np.searchsorted(self.zeros, k, side="right") - 1
        left, place = k - self.zeros[word], word * 64
        byte = word * 8
        going = np.ones(len(k), dtype=bool)
        for _ in range(8):
            here = ZEROS[self.upper[np.minimum(byte, len(self.upper) - 1)]]
            going &= left >= here
            left, byte, place = left - here * going, byte + going, place + 8 * going
        place = place + ZERO_PLACE[self.upper[np.minimum(byte, len(self.upper) - 1)], np.minimum(left, 7)]
        return np.where(high > 0, place - k, 0)

    def low_at(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), dtype=np.uint8)
        out[:, :self.low_bytes] = self.low[at]
        return out.view("<u8")[:, 0]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted number, or -1, some at a time."""
        out = np.full(len(wanted), -1)
        if self.n:
            for at in range(0, len(wanted), AT_A_TIME):
                out[at:at + AT_A_TIME] = self._find(wanted[at:at + AT_A_TIME])
        return out

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        """The successor of a number, found by halving its bucket, must be it."""
        high = np.minimum((wanted >> self.low_bits).astype(np.int64), self.top + 1)
        low = wanted & ((np.uint64(1) << self.low_bits) - np.uint64(1))
        a, b = self.bucket_start(high), self.bucket_start(np.minimum(high + 1, self.top + 1))
        b = np.where(high > self.top, a, b)
        end = b
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            less = open_ & (self.low_at(np.minimum(middle, self.n - 1)) < low)
            a, b = np.where(less, middle + 1, a), np.where(open_ & ~less, middle, b)
        hit = (a < end) & (self.low_at(np.minimum(a, self.n - 1)) == low)
        return np.where(hit, a, -1)
