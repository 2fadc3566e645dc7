"""Digital filter design and a fast state-space runner for one block of samples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CHUNK = 128


@dataclass(frozen=True)
class LinearFilter:
    """State-space form ``y = c z + d u``, ``z' = a z + b u`` and the edge padding length."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    pad: int

    @property
    def order(self) -> int:
        return len(self.b)

    @property
    def rest(self) -> np.ndarray:
        """State after an endless constant input of 1, so a step starts without a jump."""
        return np.linalg.solve(np.eye(self.order) - self.a, self.b)


def butterworth_bandpass(order: int, low: float, high: float, fs: float) -> list[np.ndarray]:
    """Second-order sections ``(b0 b1 b2 1 a1 a2)`` of a Butterworth band-pass."""
    if not 0 < low < high < fs / 2:
        raise ValueError("Digital filter critical frequencies must satisfy 0 < low < high < fs/2.")
    warped = 4.0 * np.tan(np.pi * np.array([low, high]) / fs)  # bilinear with a unit rate of 2
    width, centre2 = warped[1] - warped[0], warped[0] * warped[1]
    k = np.arange(1, order + 1)
    analog = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    half = analog * width / 2
    root = np.sqrt(half**2 - centre2 + 0j)
    poles = np.concatenate([half + root, half - root])
    digital = (4 + poles) / (4 - poles)
    gain = np.real((4.0 * width) ** order / np.prod(4 - poles))
    upper = digital[np.imag(digital) > 1e-14]
    real = np.sort(np.real(digital[np.abs(np.imag(digital)) <= 1e-14]))
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper]
    pairs += [(-(p + q), p * q) for p, q in zip(real[::2], real[1::2])]
    pairs.sort()  # lowest frequency first
    # half of the zeros lie at +1 and half at -1: each goes to the poles nearest to it, which
    # keeps sections with poles close to the unit circle well conditioned
    zeros = [(-2.0, 1.0)] * (order // 2) + [(0.0, -1.0)] * (order % 2) + [(2.0, 1.0)] * (order // 2)
    share = gain ** (1.0 / order)
    return [share * np.array([1.0, b1, b2, 0, 0, 0]) + np.array([0, 0, 0, 1.0, a1, a2])
            for (a1, a2), (b1, b2) in zip(pairs, zeros)]


def notch_section(freq: float, quality: float, fs: float) -> list[np.ndarray]:
    """Second-order notch with -3 dB width ``freq / quality``."""
    w0 = 2 * np.pi * freq / fs
    g = 1.0 / (1.0 + np.tan(w0 / quality / 2))
    return [np.array([g, -2 * g * np.cos(w0), g, 1.0, -2 * g * np.cos(w0), 2 * g - 1])]


def cascade(sections: list[np.ndarray], pad: int) -> LinearFilter:
    """Chain second-order sections into one state-space system."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        sa = np.array([[-a1, 1.0], [-a2, 0.0]])
        sb = np.array([b1 - a1 * b0, b2 - a2 * b0])
        sc = np.array([1.0, 0.0])
        a = np.block([[a, np.zeros((len(b), 2))], [np.outer(sb, c), sa]])
        b = np.concatenate([b, sb * d])
        c = np.concatenate([b0 * c, sc])
        d = b0 * d
    return LinearFilter(a, b, c, float(d), pad)


def bandpass_filter(order: int, low: float, high: float, fs: float) -> LinearFilter | None:
    """Band-pass for a channel, or None where the band covers everything."""
    nyquist = fs / 2
    if low <= 0 and high >= nyquist:
        return None
    high = nyquist - 1e-3 if high >= nyquist else high
    return cascade(butterworth_bandpass(order, low, high, fs), pad=3 * (2 * order + 1))


def notch_filter(freq: float | None, quality: float, fs: float) -> LinearFilter | None:
    if freq is None or freq <= 0 or freq >= fs / 2:
        return None
    return cascade(notch_section(freq, quality, fs), pad=9)


class BlockRunner:
    """Runs one filter over arrays, ``CHUNK`` samples per matrix product."""

    def __init__(self, flt: LinearFilter):
        self.f = flt
        powers = [np.eye(flt.order)]
        for _ in range(CHUNK):
            powers.append(powers[-1] @ flt.a)
        self.observe = np.stack([flt.c @ p for p in powers[:-1]])  # CHUNK x order
        pulse = np.concatenate([[flt.d], [flt.c @ p @ flt.b for p in powers[: CHUNK - 1]]])
        lag = np.arange(CHUNK)[:, None] - np.arange(CHUNK)[None, :]
        self.toeplitz = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
        self.reach = np.stack([powers[CHUNK - 1 - i] @ flt.b for i in range(CHUNK)], axis=1)
        self.leap = powers[CHUNK]
        self.power = lru_cache(maxsize=64)(lambda n: np.linalg.matrix_power(flt.a, n))

    def run(self, u: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and final state for input ``u`` and initial state ``z``."""
        n = len(u) // CHUNK
        main = u[: n * CHUNK].reshape(n, CHUNK)
        into = np.empty((n, self.f.order))
        push = main @ self.reach.T
        for i in range(n):
            into[i] = z
            z = self.leap @ z + push[i]
        out = (main @ self.toeplitz.T + into @ self.observe.T).ravel()
        tail = u[n * CHUNK:]
        r = len(tail)
        if r:
            last = self.toeplitz[:r, :r] @ tail + self.observe[:r] @ z
            z = self.power(r) @ z + self.reach[:, CHUNK - r:] @ tail
            out = np.concatenate([out, last])
        return out, z


def odd_extension(x: np.ndarray, pad: int, left: bool) -> np.ndarray:
    """Samples mirrored through the edge value, as a point reflection."""
    return 2 * x[0] - x[pad:0:-1] if left else 2 * x[-1] - x[-2: -pad - 2: -1]
