"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Rows are dealt to shards by a hash of their id. Each shard builds a tree: an inner node has a
vantage vector, of some tried ones that whose distances spread most, is cut at their median and knows the least and largest distance of
both children; a leaf is a block of vectors. Inner products become
distances by one more coordinate: with M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2))
and a query q becomes (q, 0); then |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, so the nearest row is
the one with the largest product, and the triangle inequality holds.

A child is skipped for a query when the triangle inequality, relaxed by ``slack``, says that it
holds nothing nearer than the neighbours found so far: ``bound > radius * slack``. With a slack
of one the search is exact; a slack below one skips more.

A query meets all shards in blocks of queries, so that neither side is ever held as a whole. Rows
whose vector is null, empty, zero, or has a null or non-finite component, or another length than
the most common one, take no part. Equal products are ordered by id; repeated ids are separate
rows, except that rows with a query's own id are no candidates of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewave.llm.store import saved
from statewave.llm.text import plain

LEAF = 512
#: Rows tried as vantage of a node, and rows that they are tried on.
TRIED, TRIED_ON = 6, 128
ROWS_PER_SHARD = 16_384
QUERIES_PER_BLOCK = 1024
#: Distances are compared with this much room for rounding, relative to the largest norm.
ROUNDING = 1e-6
FOUND = "query_id bigint, vec_id bigint, score double"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): id as a long and the vector as doubles."""
    rows = plain(rows, (id_col, vector_col))
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(
        F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v"))


class Tree:
    """Nodes in arrays; ``order`` holds the rows leaf by leaf."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x, rng = x, np.random.default_rng(seed)
        self.order = np.arange(len(x))
        self.vantage: list[int] = []
        self.near: list[tuple[float, float]] = []  # least and largest distance in the near child
        self.far: list[tuple[float, float]] = []
        self.child: list[tuple[int, int]] = []
        self.span: list[tuple[int, int]] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.span)
            if parent >= 0:
                left, right = self.child[parent]
                self.child[parent] = (node, right) if side == 0 else (left, node)
            rows = self.order[a:b]
            split = None
            if b - a > LEAF:
                tried, on = rows[rng.integers(b - a, size=TRIED)], x[rows[rng.integers(b - a, size=TRIED_ON)]]
                vantage = max(tried, key=lambda v: np.linalg.norm(on - x[v], axis=1).var())
                d = np.linalg.norm(x[rows] - x[vantage], axis=1)
                by = np.argsort(d, kind="stable")
                d = d[by]
                # The cut closest to the middle that has different distances on its sides.
                steps = np.flatnonzero(d[1:] > d[:-1]) + 1
                if len(steps):
                    split = int(steps[np.argmin(np.abs(steps - (b - a) // 2))])
                    self.order[a:b] = rows[by]
            self.span.append((a, b))
            self.child.append((-1, -1))
            if split is None:  # small, or rows that are all alike: a leaf of any size
                self.vantage.append(-1)
                self.near.append((0.0, 0.0))
                self.far.append((0.0, 0.0))
            else:
                self.vantage.append(int(vantage))
                self.near.append((d[0], d[split - 1]))
                self.far.append((d[split], d[-1]))
                todo.append((a + split, b, node, 1))
                todo.append((a, a + split, node, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in order of the components."""
    terms = q * x
    return np.cumsum(terms, axis=1, out=terms)[:, -1]


class Search:
    """The k largest products of each query over one tree; ties go to the smaller id."""

    def __init__(self, tree: Tree, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray,
                 queries: np.ndarray, largest: float, k: int, slack: float):
        self.tree, self.ids, self.vectors = tree, ids, vectors
        self.query_ids, self.queries, self.k, self.slack = query_ids, queries, k, slack
        self.largest = largest
        self.norms = np.linalg.norm(queries, axis=1)
        self.lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visited = 0

    def radius(self, who: np.ndarray) -> np.ndarray:
        worst = self.score[who, -1]
        square = self.norms[who] ** 2 + self.largest ** 2 - 2 * worst
        return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(square, 0.0)))

    def leaf(self, node: int, who: np.ndarray) -> None:
        a, b = self.tree.span[node]
        for start in range(a, b, 2 * LEAF):
            rows = self.tree.order[start:min(start + 2 * LEAF, b)]
            self.visited += len(rows) * len(who)
            rough = self.queries[who] @ self.vectors[rows].T
            room = ROUNDING * self.largest * self.norms[who]
            near = (rough >= (self.score[who, -1] - room)[:, None]) & (self.ids[rows][None] != self.query_ids[who][:, None])
            i, j = np.nonzero(near)
            if not len(i):
                continue
            # Only each query's best of the block can count: keep its k best and what may tie with them.
            if near.sum(axis=1).max() > 4 * self.k:
                masked = np.where(near, rough, -np.inf)
                least = np.partition(masked, masked.shape[1] - self.k, axis=1)[:, -self.k] if masked.shape[1] > self.k else np.full(len(who), -np.inf)
                i, j = np.nonzero(near & (masked >= (least - room)[:, None]))
            exact = products(self.queries[who[i]], self.vectors[rows[j]])
            self.merge(who, i, exact, self.ids[rows[j]])

    def merge(self, who: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(i)
        old = np.repeat(touched, self.k)
        at = np.concatenate([old, i])
        s = np.concatenate([self.score[who[touched]].ravel(), score])
        v = np.concatenate([self.found[who[touched]].ravel(), ids])
        order = np.lexsort((v, -s, at))
        at, s, v = at[order], s[order], v[order]
        first = np.searchsorted(at, touched)
        take = (first[:, None] + np.arange(self.k)).ravel()
        self.score[who[touched]] = s[take].reshape(-1, self.k)
        self.found[who[touched]] = v[take].reshape(-1, self.k)

    def visit(self, node: int, who: np.ndarray) -> None:
        """Nearest child first; queries are asked again before the second one."""
        stack = [(node, who, None)]
        while stack:
            node, who, bound = stack.pop()
            if bound is not None:
                keep = bound <= self.radius(who) * self.slack + ROUNDING * (self.largest + self.norms[who])
                who = who[keep]
            if not len(who):
                continue
            if self.tree.vantage[node] < 0:
                self.leaf(node, who)
                continue
            d = np.linalg.norm(self.lifted[who] - self.tree.x[self.tree.vantage[node]], axis=1)
            bounds = []
            for low, high in (self.tree.near[node], self.tree.far[node]):
                bounds.append(np.maximum(0.0, np.maximum(low - d, d - high)))
            left, right = self.tree.child[node]
            near_first = bounds[0] <= bounds[1]
            for first, then, side in ((1, 0, ~near_first), (0, 1, near_first)):
                if side.any():
                    stack.append(((left, right)[then], who[side], bounds[then][side]))
                    stack.append(((left, right)[first], who[side], bounds[first][side]))

    def run(self) -> pd.DataFrame:
        if len(self.ids) and len(self.queries):
            self.visit(0, np.arange(len(self.queries)))
        i, j = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"query_id": self.query_ids[i], "vec_id": self.found[i, j], "score": self.score[i, j]})


def search_pair(rows: pd.DataFrame, queries: pd.DataFrame, k: int, slack: float, largest: float) -> pd.DataFrame:
    """All queries of one block against one shard."""
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    rows = rows.sort_values("id", kind="stable")
    vectors, ids = np.stack(rows["v"].to_numpy()).astype(float), rows["id"].to_numpy()
    rest = np.sqrt(np.maximum(largest ** 2 - (vectors ** 2).sum(axis=1), 0.0))
    tree = Tree(np.hstack([vectors, rest[:, None]]))
    out = []
    for start in range(0, len(queries), QUERIES_PER_BLOCK):
        part = queries.iloc[start:start + QUERIES_PER_BLOCK]
        out.append(Search(tree, ids, vectors, part["id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(float), largest, k, slack).run())
    return pd.concat(out)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, slack: float = 1.0, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best rows of each query: query_id, rank (from 1), vec_id, score.

    Per shard and block of queries a task holds at most about ``ROWS_PER_SHARD`` rows and
    ``8 * QUERIES_PER_BLOCK`` queries; the best of each shard are merged by query.
    """
    rows, queries = usable(rows, id_col, vector_col), usable(queries, id_col, vector_col)
    rows = saved(rows)
    facts = rows.agg(F.count("*").alias("n"), F.mode(F.size("v"), deterministic=True).alias("dims"),
                     F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("largest")).first()
    dims, largest = facts["dims"] or 0, float(facts["largest"] or 0.0) * (1 + 1e-12)
    rows, queries = rows.where(F.size("v") == dims), saved(queries.where(F.size("v") == dims))
    shards = max(1, -(-facts["n"] // ROWS_PER_SHARD))
    blocks = max(1, -(-queries.count() // (8 * QUERIES_PER_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.select("id", "v", dealt(shards).alias("shard"), every(blocks).alias("block"))
    right = queries.select("id", "v", every(shards).alias("shard"), dealt(blocks).alias("block"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        lambda r, q: search_pair(r, q, k, slack, largest), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def vector_digest(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, as ``op10_nearest`` takes them."""
    rows = plain(embeddings, ("vec_id", "embedding"))
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
