"""Optimal one-to-one matching of a few cluster labels."""

from __future__ import annotations

import numpy as np


def best_matching(gain: np.ndarray) -> list[int]:
    """Row for every column of a square matrix so that the picked gains sum highest.

    Shortest augmenting paths with row and column prices; the matrix is clusters x clusters.
    """
    cost = gain.max() - gain.astype(float).T  # columns of ``gain`` look for a row
    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for start in range(n):
        slack = np.full(n, np.inf)
        came, used = np.full(n, -1), np.zeros(n, dtype=bool)
        agent, link = start, -1
        while True:
            reduced = cost[agent] - row_price[agent] - col_price
            better = ~used & (reduced < slack)
            slack[better], came[better] = reduced[better], link
            pick = int(np.where(used, np.inf, slack).argmin())
            step = slack[pick]
            row_price[start] += step
            for j in np.flatnonzero(used):
                row_price[owner[j]] += step
            col_price[used] -= step
            slack[~used] -= step
            used[pick] = True
            link = pick
            if owner[pick] < 0:
                break
            agent = owner[pick]
        while link >= 0:
            before = came[link]
            owner[link] = owner[before] if before >= 0 else start
            link = before
    out = [0] * n
    for row, agent in enumerate(owner):
        out[int(agent)] = row
    return out
