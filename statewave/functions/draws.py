"""Random draws that decide model starts.

Only a handful of numbers per recording are drawn, from a PCG64 stream with the configured
seed, so a run repeats exactly and does not depend on how Spark partitions the data.
"""

from __future__ import annotations

import numpy as np


def shared_stream(n: int, k: int, restarts: int, seed: int) -> tuple[list[int], list[list[float]]]:
    """First rows and later uniforms of ``restarts`` seedings that share one stream."""
    rng = np.random.default_rng(seed)
    first, later = [], []
    for _ in range(restarts):
        first.append(int(rng.integers(n)))
        later.append([float(rng.random()) for _ in range(k - 1)])
    return first, later


def own_streams(n: int, ks: list[int], seeds: list[int]) -> tuple[list[int], list[list[float]]]:
    """The same with one stream per model."""
    first, later = [], []
    for k, seed in zip(ks, seeds):
        rng = np.random.default_rng(seed)
        first.append(int(rng.integers(n)))
        later.append([float(rng.random()) for _ in range(k - 1)])
    return first, later


def spare_rows(n: int, k: int, seed: int, used: int, count: int) -> list[int]:
    """Replacement rows for empty clusters: draws ``used .. used+count`` after the seeding."""
    rng = np.random.default_rng(seed)
    rng.integers(n)
    rng.random(k - 1)
    return [int(rng.integers(n)) for _ in range(used + count)][used:]


def sample_rows(n: int, size: int, seed: int) -> np.ndarray:
    """Sorted row numbers of a sample without replacement, which is all rows if there are no more."""
    drawn = np.random.default_rng(seed).choice(n, min(n, size), replace=False)
    drawn.sort()
    return drawn
