"""Memory of searches in the levels of the language model."""

import tracemalloc

import numpy as np

from statewave.llm.elias_fano import EliasFano, Levels


def test_find_keeps_little_beside_its_answer():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 52, 900_000, dtype=np.uint64))
    wanted = np.concatenate([values[::2], rng.integers(0, 1 << 52, 350_000, dtype=np.uint64)])
    level = EliasFano(values, Levels())
    tracemalloc.start()
    got = level.find(wanted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    np.testing.assert_array_equal(got, np.where(values[at] == wanted, at, -1))
    assert peak < 4 * wanted.nbytes
