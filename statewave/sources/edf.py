"""European Data Format: header layout, channel scaling and seekable record ranges."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np

# Widths in bytes of the main header fields and of the fields every signal has.
MAIN_FIELDS = [("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8),
               ("header_bytes", 8), ("reserved", 44), ("records", 8), ("seconds", 8), ("signals", 4)]
SIGNAL_FIELDS = [("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8),
                 ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefilter", 80),
                 ("samples", 8), ("reserved", 32)]


@dataclass
class EDFHeader:
    start: int  # first byte of the data records
    records: int
    seconds: float
    labels: list[str]
    samples: list[int]  # per record and channel
    scale: list[float]
    offset: list[float]

    @property
    def record_bytes(self) -> int:
        return 2 * sum(self.samples)

    def rate(self, channel: int) -> float:
        return self.samples[channel] / max(self.seconds, 1e-12)


def read_header(path: str) -> EDFHeader:
    with open(path, "rb") as f:
        def field(width: int) -> str:
            return f.read(width).decode("latin-1").strip()

        def number(text: str, default: float) -> float:
            return float(text or default)

        main = {name: field(width) for name, width in MAIN_FIELDS}
        n = int(number(main["signals"], 0))
        each = {name: [field(width) for _ in range(n)] for name, width in SIGNAL_FIELDS}
    samples = [int(number(v, 0)) for v in each["samples"]]
    low = [number(v, 0) for v in each["physical_min"]]
    high = [number(v, 1) for v in each["physical_max"]]
    dlow = [number(v, -32768) for v in each["digital_min"]]
    dhigh = [number(v, 32767) for v in each["digital_max"]]
    scale = [(b - a) / (d - c) if d != c else 1.0 for a, b, c, d in zip(low, high, dlow, dhigh)]
    start, records = int(number(main["header_bytes"], 0)), int(number(main["records"], 0))
    size = os.path.getsize(path) - start
    if records <= 0:
        records = size // max(2 * sum(samples), 1)
    elif size < records * 2 * sum(samples):
        raise ValueError("Unexpected end of EDF file while reading samples.")
    return EDFHeader(start, records, number(main["seconds"], 1.0), each["label"], samples, scale,
                     [a - c * s for a, c, s in zip(low, dlow, scale)])


def read_samples(path: str, head: EDFHeader, channel: int, first: int, last: int) -> np.ndarray:
    """Physical values ``first .. last-1`` of a channel; only the records needed are read."""
    per = head.samples[channel]
    last = min(last, per * head.records)
    if last <= first:
        return np.empty(0)
    r0, r1 = first // per, -(-last // per)
    with open(path, "rb") as f:
        f.seek(head.start + r0 * head.record_bytes)
        raw = np.frombuffer(f.read((r1 - r0) * head.record_bytes), dtype="<i2")
    at = sum(head.samples[:channel])
    mine = raw.reshape(r1 - r0, -1)[:, at: at + per].reshape(-1)
    return mine[first - r0 * per: last - r0 * per] * head.scale[channel] + head.offset[channel]


@dataclass
class Resampler:
    """Rational-rate conversion by a Kaiser-windowed low-pass; every output is a local sum."""

    up: int
    down: int

    def __post_init__(self) -> None:
        g = math.gcd(self.up, self.down)
        self.up, self.down = self.up // g, self.down // g
        self.half = 10 * max(self.up, self.down)
        cut = 1.0 / max(self.up, self.down)
        t = np.arange(-self.half, self.half + 1)
        taps = cut * np.sinc(cut * t) * np.kaiser(2 * self.half + 1, 5.0)
        self.taps = taps / taps.sum() * self.up

    def length(self, n: int) -> int:
        return -(-n * self.up // self.down)

    def needs(self, first: int, last: int) -> tuple[int, int]:
        """Input range behind the outputs ``first .. last-1``."""
        return (max(0, -(-(first * self.down - self.half) // self.up)),
                ((last - 1) * self.down + self.half) // self.up + 1)

    def outputs(self, x: np.ndarray, offset: int, first: int, last: int) -> np.ndarray:
        """Outputs ``first .. last-1`` from inputs ``x`` that start at ``offset``."""
        m = np.arange(first, last)[:, None] * self.down
        lowest = -(-(m - self.half) // self.up)
        k = lowest + np.arange(2 * self.half // self.up + 1)[None, :]
        tap = self.half + m - k * self.up
        ok = (tap >= 0) & (tap <= 2 * self.half) & (k >= offset) & (k < offset + len(x))
        weight = np.where(ok, self.taps[np.clip(tap, 0, 2 * self.half)], 0.0)
        return (weight * x[np.clip(k - offset, 0, max(len(x) - 1, 0))]).sum(axis=1)
