"""Agglomerative merging of a bounded set of rows."""

from __future__ import annotations

import numpy as np


class Ward:
    """Distances from centroids and sizes, so memory stays linear in the rows."""

    def __init__(self, x: np.ndarray, size: np.ndarray | None = None):
        self.centre, self.size = x.copy(), np.ones(len(x)) if size is None else size.astype(float)

    def row(self, i: int) -> np.ndarray:
        gap = self.centre - self.centre[i]
        weight = 2.0 * self.size * self.size[i] / (self.size + self.size[i])
        return np.sqrt(weight * np.einsum("ij,ij->i", gap, gap))

    def merge(self, i: int, j: int) -> None:
        total = self.size[i] + self.size[j]
        self.centre[j] = (self.size[i] * self.centre[i] + self.size[j] * self.centre[j]) / total
        self.size[j] = total


class Pairwise:
    """Average and complete linkage on a full distance matrix."""

    def __init__(self, d: np.ndarray, method: str, size: np.ndarray | None = None):
        self.d, self.size, self.mean = d, np.ones(len(d)) if size is None else size.astype(float), method == "average"

    def row(self, i: int) -> np.ndarray:
        return self.d[i].copy()

    def merge(self, i: int, j: int) -> None:
        if self.mean:
            a, b = self.size[i], self.size[j]
            new = (a * self.d[i] + b * self.d[j]) / (a + b)
        else:
            new = np.maximum(self.d[i], self.d[j])
        self.d[j], self.d[:, j] = new, new
        self.size[j] += self.size[i]


def merges_of(work: Ward | Pairwise, n: int) -> list[tuple[float, int, int]]:
    """All merges of ``n`` clusters as (height, kept, absorbed), lowest first, by nearest-neighbour chains."""
    alive = np.ones(n, dtype=bool)
    chain: list[int] = []
    out = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            tip = chain[-1]
            d = np.where(alive, work.row(tip), np.inf)
            d[tip] = np.inf
            near = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[near]:
                near = chain[-2]
                break
            chain.append(near)
        del chain[-2:]
        low, high = sorted((tip, near))
        out.append((float(d[near]), low, high))
        work.merge(low, high)
        alive[low] = False
    return sorted(out, key=lambda m: m[0])


def distances(x: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - r) ** 2).sum(axis=1)) for r in x])


def merges(x: np.ndarray, method: str) -> list[tuple[float, int, int]]:
    """All merges of rows."""
    return merges_of(Ward(x) if method == "ward" else Pairwise(distances(x), method), len(x))


def in_tree_order(clusters: list[tuple], joins: list[tuple[int, int]]) -> list[int]:
    """Numbers of clusters in the order of the tree that joins them.

    ``clusters`` are sort keys (single rows before merged ones), ``joins`` pairs of clusters, each
    standing for all it was joined with, lowest first. Of a join's two sides the branches come
    first, then single clusters, the smaller key first; a join's key is above all before.
    """
    top = list(range(len(clusters)))
    parent = list(range(len(clusters)))
    children: dict[int, tuple[int, int]] = {}
    key: dict[int, tuple] = dict(enumerate(clusters))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for step, (i, j) in enumerate(joins):
        i, j = find(i), find(j)
        node = len(clusters) + step
        children[node] = tuple(sorted((top[i], top[j]), key=lambda v: key[v]))
        key[node] = (2, step)
        parent[j], top[i] = i, node
    numbers: list[int] = []
    stack: list[tuple[int, bool]] = [(top[find(0)], False)]
    while stack:
        node, singles = stack.pop()
        if singles:
            numbers += [c for c in children[node] if c in range(len(clusters)) and clusters[c][0] == 0]
        elif node < len(clusters):
            numbers.append(node)
        else:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(children[node]) if c >= len(clusters) or clusters[c][0] == 1)
    out = [0] * len(clusters)
    for number, c in enumerate(numbers):
        out[c] = number
    return out


def flat_clusters(x: np.ndarray, k: int, method: str) -> np.ndarray:
    """At most ``k`` clusters, numbered from 0 in dendrogram order."""
    n = len(x)
    if n <= k:
        return np.arange(n)
    ordered = merges(x, method)
    cut = ordered[n - k - 1][0]
    parent = list(range(2 * n - 1))
    top = list(range(n))  # cluster that a row's tree has grown to
    children: dict[int, tuple[int, int]] = {}
    height: dict[int, float] = {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step, (h, i, j) in enumerate(ordered):
        a, b = sorted((top[find(i)], top[find(j)]))
        node = n + step
        children[node], height[node] = (a, b), h
        root, other = find(i), find(j)
        parent[other] = root
        top[root] = node
    labels = np.empty(n, dtype=int)
    count = 0

    def paint(node: int, label: int) -> None:
        stack = [node]
        while stack:
            v = stack.pop()
            if v < n:
                labels[v] = label
            else:
                stack.extend(children[v])

    # above the cut: branches first, then single rows, left before right
    stack: list[tuple[int, bool]] = [(2 * n - 2, False)]
    while stack:
        node, singles = stack.pop()
        if singles:
            for child in children[node]:
                if child < n:
                    labels[child], count = count, count + 1
            continue
        if height[node] <= cut:
            paint(node, count)
            count += 1
            continue
        stack.append((node, True))
        stack.extend((c, False) for c in reversed(children[node]) if c >= n)
    return labels
