"""Candidate thresholds of one feature and the classes to their left."""

from __future__ import annotations

import numpy as np


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal entries begins in columns sorted together; NaN equals NaN."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        differs = c[1:] != c[:-1]
        if c.dtype.kind == "f":
            differs &= ~(np.isnan(c[1:]) & np.isnan(c[:-1]))
        new[1:] |= differs
    return np.flatnonzero(new)


def quantile_spots(limit: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``limit`` quantiles from 5 % to 95 % among ``total`` ranks, with the ranks around them."""
    step = 0.9 / (limit - 1) if limit > 1 else 0.0
    spot = np.array([0.05 + step * i for i in range(limit)]) * (total - 1)
    low = np.floor(spot).astype(np.int64)
    return spot, low, np.minimum(low + 1, total - 1)


def between(a: np.ndarray, b: np.ndarray, spot: np.ndarray, weighted: bool) -> np.ndarray:
    """Distinct quantiles from the values around them, as Spark's ``percentile`` (``weighted``) or NumPy rounds them."""
    low = np.floor(spot)
    part = spot - low
    with np.errstate(invalid="ignore"):
        if weighted:
            mixed = np.where((part == 0) | (a == b), a, (low + 1 - spot) * a + part * b)
        else:
            mixed = np.where(part < 0.5, a + (b - a) * part, b - (b - a) * (1 - part))
    return np.unique(mixed)


def class_sums(ends: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Rows of each of ``k`` classes before every one of the ascending positions ``ends``."""
    part = np.searchsorted(ends, np.arange(len(label)), side="right")
    sums = np.bincount(part * (k + 1) + label, weights=weight, minlength=(len(ends) + 1) * (k + 1))
    return np.cumsum(sums.reshape(-1, k + 1)[: len(ends), :k], axis=0).astype(np.int64)


def left_counts(v: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int, limit: int,
                weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of a whole group and the classes left of them.

    Entry i stands for ``weight[i]`` rows; label ``k`` is none of the classes.
    """
    order = np.argsort(v, kind="stable")
    v, label, weight = v[order], label[order], weight[order]
    distinct = v[run_starts(v)]
    if len(distinct) <= 1:
        thresholds = np.empty(0)
    elif len(distinct) <= limit:
        thresholds = (distinct[:-1] + distinct[1:]) / 2.0
    else:
        upto = np.cumsum(weight, dtype=np.int64)
        spot, low, high = quantile_spots(limit, int(upto[-1]))
        a, b = (v[np.searchsorted(upto, r, side="right")] for r in (low, high))
        thresholds = between(a, b, spot, weighted)
    return thresholds, class_sums(np.searchsorted(v, thresholds, side="right"), label, weight, k)


def bucket_part(v: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int, limit: int, offset: int,
                total: int) -> dict[str, np.ndarray | int]:
    """What a bucket of a group knows: values at the ranks sought (all values, if few), classes up to them."""
    order = np.argsort(v, kind="stable")
    v, label, weight = v[order], label[order], weight[order]
    distinct = v[run_starts(v)]
    upto = offset + np.cumsum(weight, dtype=np.int64)
    _, low, high = quantile_spots(limit, total)
    ranks = np.unique(np.concatenate([low, high]))
    ranks = ranks[(ranks >= offset) & (ranks < upto[-1])]
    found = v[np.searchsorted(upto, ranks, side="right")]
    kept = np.unique(np.concatenate([found, distinct])) if len(distinct) <= limit else np.unique(found)
    ends = np.append(np.searchsorted(v, kept, side="right"), len(v))
    sums = class_sums(ends, label, weight, k)
    return {"distinct": len(distinct), "ranks": ranks, "found": found, "kept": kept, "lefts": sums[:-1].ravel(),
            "classes": sums[-1]}


def join_parts(parts: list[dict], k: int, limit: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and classes left of them from the parts of a group's buckets, in their order."""
    kinds = sum(p["distinct"] for p in parts)
    kept = np.concatenate([p["kept"] for p in parts])
    if kinds <= 1:
        return np.empty(0), np.empty((0, k), dtype=np.int64)
    if kinds <= limit:
        thresholds = (kept[:-1] + kept[1:]) / 2.0
    else:
        ranks, found = (np.concatenate([p[c] for p in parts]) for c in ("ranks", "found"))
        spot, low, high = quantile_spots(limit, total)
        a, b = (found[np.searchsorted(ranks, r)] for r in (low, high))
        thresholds = between(a, b, spot, weighted=False)
    before, sums = np.zeros(k, dtype=np.int64), []
    for p in parts:
        sums.append(before + np.asarray(p["lefts"], dtype=np.int64).reshape(-1, k))
        before = before + p["classes"]
    # a threshold lies between two kept values that are neighbours in the group
    at = np.searchsorted(kept, thresholds, side="right") - 1
    return thresholds, np.where(np.isnan(thresholds)[:, None], before, np.concatenate(sums)[at])
