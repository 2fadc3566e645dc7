"""Agglomerative clustering of the windows of recordings of any length.

Every round finds each cluster's nearest one, tile by tile, and merges all pairs that are nearest
to each other. Ward, average and complete linkage are reducible: a merge brings no cluster nearer
to a third one, so these are the merges of the one-by-one order. A recording whose clusters fit one block is
finished in a task; one of no more rows needs no round. Equal rows are merged before the first round, all at
once: of rows at distance 0 only two would be nearest to each other, so a round would merge two of them.

Ward keeps a centre and a size per cluster. Average and complete linkage keep all rows and take
cluster distances from theirs, so a round costs all distances of a recording and no memory for them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewave.config import ClusterConfig
from statewave.functions.linkage import Pairwise, Ward, flat_clusters, in_tree_order, merges_of
from statewave.operators.blocks import REC, Blocks
from statewave.operators.kernel import chunks, strips
from statewave.session import cut_lineage, maybe_broadcast

METHODS = ("ward", "average", "complete")
#: Pieces of a recording up to PIECES * PIECE_BLOCKS blocks of clusters, most blocks of a piece.
PIECES, PIECE_BLOCKS = 24, 4
#: Most tasks of a round for each of the session's shuffle partitions.
TASKS = 4
MERGES = f"{REC} string, height double, kept bigint, absorbed bigint"


def hierarchical(blocks: Blocks, config: ClusterConfig | None = None) -> DataFrame:
    """``recording_id, window_index, label`` of the tree cut at ``n_clusters``."""
    cfg = config or ClusterConfig()
    method, k, width = cfg.hierarchical_linkage, cfg.n_clusters, blocks.width
    if method not in METHODS:
        raise ValueError(f"Unknown linkage: {method}")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.asarray(pdf["x"].iloc[0]).reshape(-1, width)
        return pd.DataFrame({REC: pdf[REC].iloc[0], "window_index": np.arange(len(x)),
                             "label": flat_clusters(x, k, method).astype("int32")})

    labels = blocks.short().df.select(REC, "x").groupBy(REC).applyInPandas(
        merge, f"{REC} string, window_index bigint, label int")
    if blocks.n_long:
        labels = labels.unionByName(cut_tree(blocks.long(), all_merges(blocks.long(), method), k))
    return labels


def points_of(blocks: Blocks) -> DataFrame:
    """``recording_id, cluster, row, weight, x``: every row a cluster of its own, named by its number."""
    rows = F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"int(size(x) / {blocks.width}) - 1")),
                                    lambda i: F.slice("x", i * blocks.width + 1, F.lit(blocks.width)))).alias("at", "x")
    row = F.col("start_idx") + F.col("at")
    return blocks.df.select(REC, "start_idx", rows).select(
        REC, row.alias("cluster"), row.alias("row"), F.lit(1.0).alias("weight"), "x")


def equal_rows(points: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """Points after all merges of equal rows, and these merges, at height 0."""
    same = points.groupBy(REC, "x").agg(F.min("cluster").alias("kept"), F.count("*").alias("n"))
    pairs = cut_lineage(points.join(same.where("n > 1"), [REC, "x"]).where("cluster != kept").select(
        REC, F.lit(0.0).alias("height"), "kept", F.col("cluster").alias("absorbed")))
    if method != "ward":
        return merged(points, pairs, method), pairs
    return same.select(REC, F.col("kept").alias("cluster"), F.col("kept").alias("row"),
                       F.col("n").cast("double").alias("weight"), "x"), pairs


def groups_for(rows: Column, size: int) -> Column:
    """Number of pieces of a recording of so many rows, apart from its larger clusters."""
    return F.least(F.ceil(rows * 2 / size), F.greatest(F.lit(PIECES), F.ceil(rows / (PIECE_BLOCKS * size))))


def pieces_of(points: DataFrame, size: int) -> DataFrame:
    """Points packed by whole clusters, about ``size`` to a piece; larger clusters have pieces of their own.

    ``recording_id, piece, split, cluster, weight, x`` with arrays and a flat x.
    """
    sizes = points.groupBy(REC, "cluster").agg(F.count("*").alias("n"))
    totals = points.groupBy(REC).agg(groups_for(F.count("*"), size).alias("groups"))
    sizes = sizes.join(totals, REC).withColumn("split", F.col("n") > size)
    piece = F.when(F.col("split"), F.concat_ws(":", F.lit("s"), "cluster", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / size)))).otherwise(
        F.concat_ws(":", F.lit("g"), F.pmod(F.xxhash64("cluster"), F.col("groups"))))
    packed = points.join(sizes, [REC, "cluster"]).groupBy(REC, piece.alias("piece"), "split").agg(
        F.sort_array(F.collect_list(F.struct("cluster", "weight", "x"))).alias("p"))
    return packed.select(REC, "piece", "split", F.col("p.cluster").alias("cluster"), F.col("p.weight").alias("weight"),
                         F.flatten("p.x").alias("x"))


class Tile:
    """Two pieces of one recording (or one and itself)."""

    def __init__(self, pdf: pd.DataFrame, width: int):
        pdf = pdf.sort_values("piece")
        self.recording, self.same, self.split = pdf[REC].iloc[0], len(pdf) == 1, bool(pdf["split"].any())
        first, last = pdf.iloc[0], pdf.iloc[-1]
        (self.a, self.na, self.wa, self.xa, _), (self.b, self.nb, self.wb, self.xb, self.starts) = (
            self.clusters(r, width) for r in (first, last))

    def between(self, method: str) -> np.ndarray:
        """Sums of the distances between the rows of clusters, or the largest of them."""
        total = np.zeros((len(self.a), len(self.b)))
        gather = np.maximum if method == "complete" else np.add
        of = np.repeat(np.arange(len(self.a)), self.na)
        for rows, _, d in strips(self.xa, [self.xb]):
            d = gather.reduceat(np.sqrt(np.maximum(d, 0.0, out=d), out=d), self.starts, axis=1)
            here = of[rows]
            d = gather.reduceat(d, np.flatnonzero(np.r_[True, here[1:] != here[:-1]]), axis=0)
            part = total[here[0]:here[-1] + 1]
            gather(part, d, out=part)
        return np.triu(total, 1) + np.triu(total, 1).T if self.same else total

    def nearest_ward(self) -> pd.DataFrame:
        """The nearest cluster of each one by the squared Ward distance, of equal ones the first by name."""
        n, m = len(self.a), len(self.b)
        row_d, row_at, col_d, col_at = np.full(n, np.inf), np.zeros(n, dtype=int), np.full(m, np.inf), np.zeros(m, dtype=int)
        parts = chunks(self.xb)
        begin = np.cumsum([0] + [len(p) for p in parts])
        for rows, k, d in strips(self.xa, parts):
            cols = slice(begin[k], begin[k + 1])
            if self.same and cols.stop <= rows.start + 1:
                continue  # each pair once
            np.maximum(d, 0.0, out=d)
            wa, wb = self.wa[rows, None], self.wb[cols]
            d *= 2 * wa
            d *= wb
            d /= wa + wb
            if self.same and cols.start < rows.stop:
                d[np.arange(rows.start, rows.stop)[:, None] >= np.arange(cols.start, cols.stop)] = np.inf
            for low, at, axis, mine, off in ((row_d, row_at, 1, rows, cols.start), (col_d, col_at, 0, cols, rows.start)):
                best = d.argmin(axis=axis)
                value = np.take_along_axis(d, np.expand_dims(best, axis), axis).ravel()
                less = np.flatnonzero(value < low[mine])
                low[mine][less], at[mine][less] = value[less], best[less] + off
        mine, other = np.concatenate([self.a, self.b]), np.concatenate([self.b[row_at], self.a[col_at]])
        out = pd.DataFrame({REC: self.recording, "cluster": pd.Series(mine, dtype="Int64"), "d": np.concatenate([row_d, col_d]),
                            "low": np.minimum(mine, other), "high": np.maximum(mine, other)})
        return out[np.isfinite(out["d"])]

    @staticmethod
    def clusters(piece: pd.Series, width: int) -> tuple[np.ndarray, ...]:
        """Names, sizes and weights of a piece's clusters, its rows, and where each cluster begins."""
        cluster = np.asarray(piece["cluster"])
        start = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
        return (cluster[start], np.diff(np.r_[start, len(cluster)]), np.asarray(piece["weight"])[start],
                np.asarray(piece["x"], dtype=float).reshape(-1, width), start)


def tiled(pieces: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tiles: int) -> DataFrame:
    """``fn(two pieces)`` for every pair of pieces of a recording, and for each one alone.

    A tile costs far more than its bytes suggest: tasks are asked for by the number of ``tiles``, not by size.
    """
    tasks = max(1, min(tiles, TASKS * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = pieces.groupBy(REC).agg(F.collect_list("piece").alias("pieces"))
    rows = pieces.join(every, REC).withColumn("other", F.explode("pieces")).drop("pieces")
    return rows.withColumns({"i": F.least("piece", "other"), "j": F.greatest("piece", "other")}).drop("other").repartition(
        tasks, REC, "i", "j").groupBy(REC, "i", "j").applyInPandas(fn, schema)


def nearest(pieces: DataFrame, sizes: DataFrame, method: str, width: int, tiles: int) -> DataFrame:
    """``recording_id, cluster, best``: each cluster's nearest pair (d, low, high), ties by names.

    ``d`` is squared for Ward linkage: roots of different numbers may be equal, and both sides of a pair must agree.
    """
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = Tile(pdf, width)
        if method == "ward":
            return tile.nearest_ward()
        a, b, d = tile.a, tile.b, tile.between(method)
        low, high = np.minimum(a[:, None], b), np.maximum(a[:, None], b)
        if tile.split:  # parts of the distances of a cluster in several pieces
            i, j = np.nonzero(low != high)
            return pd.DataFrame({REC: tile.recording, "cluster": pd.Series([None] * len(i), dtype="Int64"),
                                 "d": d[i, j], "low": low[i, j], "high": high[i, j]})
        if method == "average":
            d = d / (tile.na[:, None] * tile.nb)
        if tile.same:
            np.fill_diagonal(d, np.inf)
        i, j = np.arange(len(a)), np.arange(len(b))
        near_a, near_b = d.argmin(axis=1), d.argmin(axis=0)
        rows = np.concatenate([i, near_b]), np.concatenate([near_a, j])
        out = pd.DataFrame({REC: tile.recording, "cluster": pd.Series(np.concatenate([a, b]), dtype="Int64"),
                            "d": d[rows], "low": low[rows], "high": high[rows]})
        return out[np.isfinite(out["d"])]

    found = tiled(pieces, best, f"{REC} string, cluster bigint, d double, low bigint, high bigint", tiles)
    if method != "ward":
        found = cut_lineage(found)
        size = lambda side: sizes.select(REC, F.col("cluster").alias(side), F.col("n").alias(f"n_{side}"))
        part = F.max("d") if method == "complete" else F.sum("d")
        whole = found.where("cluster is null").groupBy(REC, "low", "high").agg(part.alias("d")).join(
            size("low"), [REC, "low"]).join(size("high"), [REC, "high"])
        d = F.col("d") if method == "complete" else F.col("d") / (F.col("n_low") * F.col("n_high"))
        found = found.where("cluster is not null").unionByName(whole.select(
            REC, F.explode(F.array("low", "high")).alias("cluster"), d.alias("d"), "low", "high"))
    return found.groupBy(REC, "cluster").agg(F.min(F.struct("d", "low", "high")).alias("best"))


def merged(points: DataFrame, pairs: DataFrame, method: str) -> DataFrame:
    """Points after the merges ``pairs`` (kept, absorbed)."""
    renamed = points.join(pairs.select(REC, F.col("absorbed").alias("cluster"), "kept"), [REC, "cluster"], "left").withColumn(
        "cluster", F.coalesce("kept", "cluster")).drop("kept")
    if method != "ward":
        return renamed
    weighted = renamed.withColumn("x", F.transform("x", lambda v: v * F.col("weight")))
    two = F.collect_list(F.struct("weight", "x")).alias("p")  # one or two
    total = F.aggregate("p", F.lit(0.0), lambda s, p: s + p["weight"])
    return weighted.groupBy(REC, "cluster").agg(two).select(REC, "cluster", total.alias("weight"), F.when(
        F.size("p") == 2, F.zip_with(F.col("p")[0]["x"], F.col("p")[1]["x"], lambda a, b: a + b)).otherwise(
        F.col("p")[0]["x"]).alias("sum")).select(
        REC, "cluster", F.col("cluster").alias("row"), "weight", F.transform("sum", lambda v: v / F.col("weight")).alias("x"))


def all_merges(blocks: Blocks, method: str) -> DataFrame:
    """``recording_id, height, kept, absorbed`` of every merge; a cluster is named by its first row."""
    points, done = equal_rows(cut_lineage(points_of(blocks)), method)
    points, width, size = cut_lineage(points), blocks.width, blocks.size
    height = F.sqrt("best.d") if method == "ward" else F.col("best.d")
    while True:
        sizes = points.groupBy(REC, "cluster").agg(F.count("*").alias("n"))
        sizes = sizes if method == "ward" else cut_lineage(sizes)
        many = cut_lineage(sizes.groupBy(REC).agg(F.count("*").alias("clusters"), F.sum("n").alias("rows")).where(
            F.col("clusters") > size))
        groups = groups_for(F.col("rows"), size)
        tiles = many.agg(F.sum(groups * (groups + 1) / 2)).first()[0]
        if tiles is None:
            break
        active = points.join(many.select(REC), REC, "left_semi")
        best = nearest(pieces_of(active, size), sizes, method, width, int(tiles))
        pairs = cut_lineage(best.groupBy(REC, "best").agg(F.count("*").alias("n")).where("n = 2").select(
            REC, height.alias("height"), F.col("best.low").alias("kept"), F.col("best.high").alias("absorbed")))
        done = done.unionByName(pairs)
        points = cut_lineage(merged(points, pairs, method))
    return done.unionByName(finished(points, method, width, size))


def finished(points: DataFrame, method: str, width: int, size: int) -> DataFrame:
    """The merges of recordings with at most ``size`` clusters, each in a task."""
    def rows(name: str, clusters: np.ndarray, work: Ward | Pairwise) -> pd.DataFrame:
        label = clusters.copy()  # a merged cluster is named by its first row
        out = []
        for height, low, high in merges_of(work, len(clusters)):
            out.append((name, height, min(label[low], label[high]), max(label[low], label[high])))
            label[high] = min(label[low], label[high])
        return pd.DataFrame(out, columns=[REC, "height", "kept", "absorbed"])

    if method == "ward":
        def centres(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("cluster")
            x = np.stack([np.asarray(v) for v in pdf["x"]])
            return rows(pdf[REC].iloc[0], pdf["cluster"].to_numpy(), Ward(x, pdf["weight"].to_numpy()))

        return points.groupBy(REC).applyInPandas(centres, MERGES)

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = Tile(pdf, width)
        return pd.DataFrame({REC: [tile.recording], "same": [tile.same], "a": [tile.a.tobytes()], "b": [tile.b.tobytes()],
                             "n": [tile.na.astype(np.int64).tobytes()], "d": [tile.between(method).tobytes()]})

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = [(same, *(np.frombuffer(v, np.int64) for v in more), np.frombuffer(d)) for same, *more, d in zip(
            *(pdf[c] for c in ("same", "a", "b", "n", "d")))]
        clusters = np.unique(np.concatenate([a for _, a, *_ in tiles]))
        d, size = np.zeros((len(clusters), len(clusters))), np.zeros(len(clusters))
        for same, a, b, n, part in tiles:
            i, j, part = np.searchsorted(clusters, a), np.searchsorted(clusters, b), part.reshape(len(a), len(b))
            for at, block in [(np.ix_(i, j), part)] if same else [(np.ix_(i, j), part), (np.ix_(j, i), part.T)]:
                d[at] = np.maximum(d[at], block) if method == "complete" else d[at] + block
            if same:
                size[i] += n
        return rows(pdf[REC].iloc[0], clusters, Pairwise(d / np.outer(size, size) if method == "average" else d, method, size))

    schema = f"{REC} string, same boolean, a binary, b binary, n binary, d binary"
    groups = groups_for(F.col("rows"), size)
    tiles = points.groupBy(REC).agg(F.count("*").alias("rows")).agg(F.sum(groups * (groups + 1) / 2)).first()[0] or 1
    return tiled(pieces_of(points, size), parts, schema, int(tiles)).groupBy(REC).applyInPandas(assemble, MERGES)


def roots_of(pointers: DataFrame) -> DataFrame:
    """``recording_id, node, root`` from (node, root) with one step each, by doubling the steps."""
    while True:
        onward = pointers.select(REC, F.col("node").alias("root"), F.col("root").alias("next"))
        longer = cut_lineage(pointers.join(onward, [REC, "root"], "left").select(
            REC, "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        pointers = longer.select(REC, "node", "root")
        if longer.where("moved").isEmpty():
            return pointers


def cut_tree(blocks: Blocks, merges: DataFrame, k: int) -> DataFrame:
    """Rows with the numbers of their clusters, at most ``k`` for each recording, in the order of the tree."""
    merges = cut_lineage(merges)
    order = Window.partitionBy(REC).orderBy(F.desc("height"), "kept", "absorbed")
    top = merges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    cuts = top.groupBy(REC).agg(F.when(F.count("*") == k, F.min("height")).otherwise(F.lit(-1.0)).alias("cut"))
    cuts = cut_lineage(cuts)
    merges = merges.join(maybe_broadcast(cuts, blocks.n_recordings, 64), REC)
    low = cut_lineage(merges.where("height <= cut").select(REC, "height", "kept", "absorbed"))
    roots = roots_of(low.select(REC, F.col("absorbed").alias("node"), F.col("kept").alias("root")))
    above = merges.where("height > cut").select(REC, "height", "kept", "absorbed")
    grown = low.select(REC, F.col("kept").alias("node"), "height").join(roots, [REC, "node"], "left").groupBy(
        REC, F.coalesce("root", "node").alias("node")).agg(F.max("height").alias("height"))
    # the names of all final clusters: those that merges above the cut join, or the only one
    names = above.select(REC, F.explode(F.array("kept", "absorbed")).alias("node")).union(
        cuts.select(REC, F.lit(0).cast("bigint").alias("node"))).distinct()
    clusters = names.join(grown, [REC, "node"], "left").select(
        REC, "node", "height", F.lit(None).cast("bigint").alias("other"))
    joins = above.select(REC, F.col("kept").alias("node"), "height", F.col("absorbed").alias("other"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["other"].isna()].sort_values("node")
        ties = pdf[pdf["other"].notna()].sort_values(["height", "node", "other"])
        place = {n: i for i, n in enumerate(own["node"])}
        keys = [(0, n) if np.isnan(h) else (1, h, n) for n, h in zip(own["node"], own["height"])]
        label = in_tree_order(keys, [(place[a], place[int(b)]) for a, b in zip(ties["node"], ties["other"])])
        return pd.DataFrame({REC: pdf[REC].iloc[0], "root": own["node"].to_numpy(), "label": np.array(label, dtype=np.int32)})

    labels = clusters.unionByName(joins).groupBy(REC).applyInPandas(number, f"{REC} string, root bigint, label int")
    rows = blocks.lengths.select(REC, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") - 1)).alias("window_index"))
    return rows.join(roots.withColumnRenamed("node", "window_index"), [REC, "window_index"], "left").withColumn(
        "root", F.coalesce("root", "window_index")).join(
        maybe_broadcast(labels, blocks.n_recordings * k, 32), [REC, "root"]).select(REC, "window_index", "label")
