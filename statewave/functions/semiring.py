"""Matrix products under the three algebras that block-wise recurrences need.

``linear``  (+, x)          state of a linear filter
``log``     (logsumexp, +)  forward and backward messages of a hidden Markov model
``max``     (max, +)        best-path scores

Arrays carry any number of leading model axes; the last two are a square matrix, or the
last one a row vector. A row vector is moved over a block by ``vector @ block``.
"""

from __future__ import annotations

import numpy as np


def logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def product(a: np.ndarray, b: np.ndarray, algebra: str) -> np.ndarray:
    """``a @ b``; ``a`` may be a matrix or, with one axis less than ``b``, a row vector."""
    vector = a.ndim == b.ndim - 1
    left = a[..., None, :] if vector else a
    if algebra == "linear":
        out = left @ b
    else:
        pairs = left[..., :, :, None] + b[..., None, :, :]
        out = pairs.max(axis=-2) if algebra == "max" else logsumexp(pairs, axis=-2)
    return out[..., 0, :] if vector else out
