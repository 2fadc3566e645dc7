"""K-means with many restarts.

A recording that fits one block is fitted where the block lies, in one pass and without a
shuffle. One of a few blocks is gathered in tasks that fit a share of the models each. Longer recordings take one pass over all of their blocks per iteration: centres
live in a small state table with one row per recording; every restart (and every
state count a hidden Markov model wants to try) is a slice of the same array, so all of
them share each pass. Rows never leave their block: a pass returns sums per block, Spark
adds them up with map-side partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statewave.config import ClusterConfig
from statewave.functions.arrays import list_column, rows_of
from statewave.functions.draws import own_streams, shared_stream, spare_rows
from statewave.operators.blocks import REC, Blocks, sum_vectors
from statewave.operators.em import any_of, summed
from statewave.session import cut_lineage

RTOL, ATOL = 1e-5, 1e-8


@dataclass(frozen=True)
class Starts:
    """What to fit together: a cluster count and a seed per model."""

    ks: tuple[int, ...]
    seeds: tuple[int, ...]
    shared: bool  # one random stream for all models, empty clusters take the farthest row

    @property
    def offsets(self) -> list[int]:
        return [0, *np.cumsum(self.ks).tolist()]

    def slots(self, model: int) -> range:
        return range(self.offsets[model], self.offsets[model + 1])


def sq_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """``rows x centres`` squared Euclidean distances."""
    out = np.empty((len(x), len(centers)))
    for j, c in enumerate(centers):
        gap = x - c
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def rows_at(blocks: Blocks, wanted: DataFrame) -> DataFrame:
    """Fetch feature rows by number: ``recording_id, slot, idx`` -> ``recording_id, slot, row``."""
    width = blocks.width
    keyed = wanted.withColumn("block", F.expr(f"idx div {blocks.size}"))
    return keyed.join(blocks.df, [REC, "block"]).select(
        REC, "slot",
        F.slice("x", ((F.col("idx") - F.col("start_idx")) * width + 1).cast("int"),
                F.lit(width)).alias("row"))


def _draws(starts: Starts):
    ks, seeds = list(starts.ks), list(starts.seeds)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            first, later = [], []
            for n in batch.to_pylist():
                f, u = (shared_stream(n, ks[0], len(ks), seeds[0]) if starts.shared
                        else own_streams(n, ks, seeds))
                first.append(np.array(f, dtype=float))
                later.append(np.concatenate([np.asarray(r, dtype=float) for r in u]))
            yield pa.StructArray.from_arrays([list_column(first), list_column(later)],
                                             names=["first", "later"])

    return F.arrow_udf(run, "struct<first:array<double>, later:array<double>>")


def _chosen(starts: Starts, step: int) -> list[range]:
    """Positions of each model's centres while ``step`` of them are chosen."""
    out, at = [], 0
    for k in starts.ks:
        have = min(step, k)
        out.append(range(at, at + have))
        at += have
    return out


def seed_centers(blocks: Blocks, starts: Starts) -> DataFrame:
    """Distance-weighted seeding (k-means++): ``recording_id, slot, row``.

    A centre is drawn by locating a uniform number in the running total of distances: the
    block totals say which block holds it, then that block alone finds the row.
    """
    width, size = blocks.width, blocks.size
    draws = cut_lineage(blocks.lengths.select(REC, "n_rows", _draws(starts)("n_rows").alias("d"))
                        .select(REC, "n_rows", "d.*"))
    first = draws.select(REC, F.posexplode("first").alias("m", "idx"))
    offsets = F.array(*[F.lit(o) for o in starts.offsets[:-1]])
    wanted = first.select(REC, offsets[F.col("m")].alias("slot"), F.col("idx").cast("bigint"))
    seeds = cut_lineage(rows_at(blocks, wanted))
    later_base = np.concatenate([[0], np.cumsum([k - 1 for k in starts.ks])]).tolist()
    for step in range(1, max(starts.ks)):
        parts = _chosen(starts, step)
        open_models = [m for m, k in enumerate(starts.ks) if k > step]

        def nearest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for x_col, c_col in batches:
                out = []
                for x, c in zip(rows_of(x_col), rows_of(c_col)):
                    d = sq_distances(x.reshape(-1, width), c.reshape(-1, width))
                    out.append(np.array([d[:, list(parts[m])].min(axis=1).sum()
                                         for m in open_models]))
                yield list_column(out)

        def locate(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for x_col, c_col, model, rest in batches:
                out = []
                for x, c, i, r in zip(rows_of(x_col), rows_of(c_col), model.to_pylist(),
                                      rest.to_pylist()):
                    c = c.reshape(-1, width)[list(parts[open_models[i]])]
                    run = np.cumsum(sq_distances(x.reshape(-1, width), c).min(axis=1))
                    out.append(min(int(np.searchsorted(run, r, side="right")), len(run) - 1))
                yield pa.array(out, type=pa.int64())

        centers = seeds.groupBy(REC).agg(
            F.sort_array(F.collect_list(F.struct("slot", "row"))).alias("s")
        ).select(REC, F.flatten("s.row").alias("c"))
        row_bytes = 8 * width * sum(starts.ks) + 64
        near = blocks.with_state(centers, row_bytes)
        totals = near.select(REC, "block", F.posexplode(
            F.arrow_udf(nearest, "array<double>")("x", "c")).alias("i", "mass"))
        running = W.partitionBy(REC, "i").orderBy("block")
        uniform = F.array(*[F.lit(later_base[m] + step - 1) for m in open_models])
        located = (
            totals.withColumn("upto", F.sum("mass").over(running))
            .withColumn("total", F.sum("mass").over(W.partitionBy(REC, "i")))
            .join(draws, REC)
            .withColumn("u", F.element_at("later", uniform[F.col("i")] + 1))
            .withColumn("target", F.col("u") * F.col("total"))
        )
        flat = F.floor(F.col("u") * F.col("n_rows"))
        hit = ((F.col("total") > 0) & (F.col("upto") > F.col("target"))
               | (F.col("total") <= 0) & (F.col("block") == F.floor(flat / size)))
        picks = located.filter(hit).groupBy(REC, "i").agg(
            F.min_by(F.struct("block", F.when(
                F.col("total") > 0, F.col("target") - F.col("upto") + F.col("mass")
            ).alias("rest"), flat.alias("flat")), "block").alias("p")
        ).select(REC, "i", F.col("p.block").alias("block"), F.col("p.rest").alias("rest"),
                 F.col("p.flat").alias("flat"))
        slot = F.array(*[F.lit(starts.offsets[m] + step) for m in open_models])
        found = picks.join(near, [REC, "block"]).withColumn(
            "at", F.when(F.col("rest").isNull(), F.col("flat") - F.col("start_idx")).otherwise(
                F.arrow_udf(locate, "bigint")("x", "c", "i", F.coalesce("rest", F.lit(0.0)))))
        fresh = found.select(REC, slot[F.col("i")].alias("slot"), F.slice(
            "x", (F.col("at") * width + 1).cast("int"), F.lit(width)).alias("row"))
        seeds = cut_lineage(seeds.unionByName(fresh))
    return seeds


def lloyd_sums(x: np.ndarray, c: np.ndarray, prev: np.ndarray | None,
               starts: Starts) -> np.ndarray:
    """One block's answer: per centre the row count and row sum, per model the labels that
    changed since ``prev``."""
    d = sq_distances(x, c)
    old = None if starts.shared or prev is None else sq_distances(x, prev)
    counts, sums, moved = [], [], []
    for m, k in enumerate(starts.ks):
        cols = list(starts.slots(m))
        label = d[:, cols].argmin(axis=1)
        was = 0 if old is None else old[:, cols].argmin(axis=1)
        moved.append(float((label != was).sum()))
        member = (label[None, :] == np.arange(k)[:, None]).astype(float)
        counts.append(member.sum(axis=1))
        sums.append((member @ x).ravel())
    return np.concatenate(counts + sums + [np.array(moved)])


def recentre(c: np.ndarray, done: np.ndarray, stat: np.ndarray, fills: dict[int, np.ndarray],
             starts: Starts) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """New centres, per-model done flags (1/0) and the slots of empty clusters without a fill."""
    total, width = len(c), c.shape[1]
    counts = stat[:total]
    sums = stat[total: total + total * width].reshape(-1, width)
    moved = stat[total + total * width:]
    fresh = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    flags, empty = done.copy(), []
    for m in range(len(starts.ks)):
        cols = list(starts.slots(m))
        if done[m]:
            fresh[cols] = c[cols]
            continue
        for s in cols:
            if counts[s] == 0:
                fresh[s] = fills.get(s, c[s])
                if s not in fills:
                    empty.append(s)
        close = np.all(np.abs(fresh[cols] - c[cols]) <= ATOL + RTOL * np.abs(c[cols]))
        flags[m] = float(close and (starts.shared or moved[m] == 0))
    return fresh, flags, empty


def fit_in_block(x: np.ndarray, starts: Starts, iterations: int, only: list[int] | None = None) -> np.ndarray:
    """All models (or ``only`` some) for a recording whose rows are all here, same draws and steps."""
    n, rngs = len(x), [np.random.default_rng(s) for s in starts.seeds]
    seeds = []
    for m, k in enumerate(starts.ks):
        rng = rngs[0] if starts.shared else rngs[m]
        if only is not None and m not in only:
            if starts.shared:  # the next model's draws follow on those of this one
                rng.integers(n), rng.random(k - 1)
            continue
        chosen = [int(rng.integers(n))]
        while len(chosen) < k:
            mass = sq_distances(x, x[chosen]).min(axis=1)
            if mass.sum() > 0:
                chosen.append(int(rng.choice(n, p=mass / mass.sum())))
            else:
                # all rows coincide with a centre: a shared stream draws by equal weights, as before
                chosen.append(int(rng.choice(n, p=np.full(n, 1 / n)) if starts.shared else rng.integers(n)))
        seeds.append(x[chosen])
    if only is not None:
        rngs = [rngs[m] for m in only]
        starts = Starts(tuple(starts.ks[m] for m in only), tuple(starts.seeds[m] for m in only), starts.shared)
    c, prev, done = np.concatenate(seeds), None, np.zeros(len(starts.ks))
    for _ in range(iterations):
        stat = lloyd_sums(x, c, prev, starts)
        fresh, flags, empty = recentre(c, done, stat, {}, starts)
        if empty:
            model = {s: m for m in range(len(starts.ks)) for s in starts.slots(m)}
            fills = {}
            for s in empty:
                if starts.shared:
                    near = sq_distances(x, c[list(starts.slots(model[s]))]).min(axis=1)
                    fills[s] = x[near.argmax()]
                else:
                    fills[s] = x[int(rngs[model[s]].integers(n))]
            fresh, flags, _ = recentre(c, done, stat, fills, starts)
        c, prev, done = fresh, c, flags
        if done.all():
            break
    return c


def _lloyd(starts: Starts, width: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, c_col, p_col in batches:
            yield list_column([
                lloyd_sums(x.reshape(-1, width), c.reshape(-1, width),
                           p.reshape(-1, width) if len(p) else None, starts)
                for x, c, p in zip(rows_of(x_col), rows_of(c_col), rows_of(p_col))])

    return F.arrow_udf(run, "array<double>")


def _recentre(starts: Starts, width: int):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for c_col, done_col, stat_col, fill_col in batches:
            new_c, new_done, holes = [], [], []
            for c, done, stat, fill in zip(rows_of(c_col), rows_of(done_col), rows_of(stat_col),
                                           rows_of(fill_col)):
                fills = {int(r[0]): r[1:] for r in fill.reshape(-1, width + 1)}
                fresh, flags, empty = recentre(c.reshape(-1, width), done, stat, fills, starts)
                new_c.append(fresh.ravel())
                new_done.append(flags)
                holes.append(np.array(empty, dtype=float))
            yield pa.StructArray.from_arrays(
                [list_column(new_c), list_column(new_done), list_column(holes)],
                names=["c", "done", "holes"])

    return F.arrow_udf(run, "struct<c:array<double>, done:array<double>, holes:array<double>>")


def _farthest(starts: Starts, width: int):
    """Per model with an empty cluster: the row farthest from its centre."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, c_col in batches:
            out = []
            for x, c in zip(rows_of(x_col), rows_of(c_col)):
                d = sq_distances(x.reshape(-1, width), c.reshape(-1, width))
                cells = []
                for m in range(len(starts.ks)):
                    near = d[:, list(starts.slots(m))].min(axis=1)
                    cells += [near.max(), float(near.argmax())]
                out.append(np.array(cells))
            yield list_column(out)

    return F.arrow_udf(run, "array<double>")


def _fill_rows(blocks: Blocks, holed: DataFrame, starts: Starts) -> DataFrame:
    """Rows that replace the centres of empty clusters: ``recording_id, fill``."""
    width = blocks.width
    model_of = np.repeat(np.arange(len(starts.ks)), starts.ks).tolist()
    holes = holed.select(REC, F.explode("holes").alias("slot")).select(
        REC, F.col("slot").cast("int"),
        F.array(*[F.lit(m) for m in model_of])[F.col("slot").cast("int")].alias("m"))
    if starts.shared:
        far = blocks.with_state(holed.select(REC, F.col("prev").alias("c")),
                                8 * width * sum(starts.ks) + 64).select(
            REC, "start_idx", _farthest(starts, width)("x", "c").alias("f"))
        cell = far.select(REC, "start_idx", "f", F.explode(
            F.sequence(F.lit(0), F.lit(len(starts.ks) - 1))).alias("m")).select(
            REC, "m", F.col("f")[F.col("m") * 2].alias("d"),
            (F.col("start_idx") + F.col("f")[F.col("m") * 2 + 1]).cast("bigint").alias("idx"))
        rows = cell.groupBy(REC, "m").agg(
            F.max_by("idx", F.struct("d", -F.col("idx"))).alias("idx"))
        wanted = holes.join(rows, [REC, "m"]).select(REC, "slot", "idx")
    else:
        ks, seeds = starts.ks, starts.seeds

        def draw(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for n, m, used, rank in batches:
                yield pa.array([
                    spare_rows(a, ks[b], seeds[b], int(c) + r, 1)[0]
                    for a, b, c, r in zip(n.to_pylist(), m.to_pylist(), used.to_pylist(),
                                          rank.to_pylist())], type=pa.int64())

        rank = F.row_number().over(W.partitionBy(REC, "m").orderBy("slot")) - 1
        used = holed.select(REC, "spent")
        wanted = (
            holes.withColumn("rank", rank).join(used, REC).join(blocks.lengths, REC)
            .select(REC, "slot", F.arrow_udf(draw, "bigint")(
                "n_rows", "m", F.element_at("spent", F.col("m") + 1), "rank").alias("idx")))
    rows = rows_at(blocks, wanted)
    return rows.groupBy(REC).agg(F.flatten(F.collect_list(
        F.concat(F.array(F.col("slot").cast("double")), F.col("row")))).alias("fill"))


def fit_kmeans(blocks: Blocks, starts: Starts, iterations: int) -> DataFrame:
    """Fit every model of ``starts``: ``recording_id, c`` (all centres, flattened)."""
    width = blocks.width

    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x_col in batches:
            yield list_column([fit_in_block(x.reshape(-1, width), starts, iterations).ravel()
                               for x in rows_of(x_col)])

    fits = blocks.short().df.select(REC, F.arrow_udf(whole, "array<double>")("x").alias("c"))
    if blocks.n_long > blocks.n_vast:
        fits = fits.unionByName(_fit_by_shares(blocks, starts, iterations))
    if blocks.n_vast:
        fits = fits.unionByName(_fit_by_passes(blocks.vast(), starts, iterations))
    return fits


def _fit_by_shares(blocks: Blocks, starts: Starts, iterations: int) -> DataFrame:
    """Recordings that are fitted in tasks, a share of the models in each."""
    width, models = blocks.width, len(starts.ks)
    rows, shares = blocks.gathered(models)

    def some(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, share in batches:
            yield list_column([fit_in_block(x.reshape(-1, width), starts, iterations, list(range(i, models, shares))).ravel()
                               for x, i in zip(rows_of(x_col), share.to_pylist())])

    def collect(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.empty((sum(starts.ks), width))
        for i, c in zip(pdf["share"], pdf["c"]):
            out[[s for m in range(i, models, shares) for s in starts.slots(m)]] = np.asarray(c).reshape(-1, width)
        return pd.DataFrame({REC: pdf[REC].iloc[:1].to_list(), "c": [out.ravel()]})

    return rows.select(REC, "share", F.arrow_udf(some, "array<double>")("x", "share").alias("c")).groupBy(
        REC).applyInPandas(collect, f"{REC} string, c array<double>")


def _count_between(column: str, low: int, high: int) -> Column:
    """How many entries of an array lie from ``low`` to below ``high``."""
    return F.size(F.filter(column, lambda h: (h >= low) & (h < high))).cast("double")


def _fit_by_passes(blocks: Blocks, starts: Starts, iterations: int) -> DataFrame:
    width = blocks.width
    row_bytes = 16 * width * sum(starts.ks) + 64
    models = len(starts.ks)
    zeros = F.array(*[F.lit(0.0)] * models)
    nothing = F.array().cast("array<double>")
    state = seed_centers(blocks, starts).groupBy(REC).agg(
        F.sort_array(F.collect_list(F.struct("slot", "row"))).alias("s")
    ).select(REC, F.flatten("s.row").alias("c"), nothing.alias("prev"), zeros.alias("done"),
             zeros.alias("spent"))
    finished = None
    move = _recentre(starts, width)

    def answer(x: np.ndarray, c: np.ndarray, prev: np.ndarray) -> np.ndarray:
        return lloyd_sums(x.reshape(-1, width), c.reshape(-1, width), prev.reshape(-1, width) if len(prev) else None, starts)

    def finish(c: np.ndarray, prev: np.ndarray, done: np.ndarray, spent: np.ndarray, stat: np.ndarray) -> dict:
        fresh, flags, empty = recentre(c.reshape(-1, width), done, stat, {}, starts)
        return {"c": fresh.ravel(), "prev": c, "done": flags, "spent": spent, "was": done,
                "holes": np.array(empty, dtype=float), "stats": stat if empty else np.empty(0)}

    carried = ["c", "prev", "done", "spent"]
    schema = ", ".join(f"{c} array<double>" for c in [*carried, "was", "holes", "stats"])
    still = F.expr("exists(done, d -> d = 0)")
    for _ in range(iterations):
        step = cut_lineage(summed(blocks.with_state(state, row_bytes), ["x", "c", "prev"], answer, carried, finish, schema))
        left, settled, holes = any_of(step, still, ~still, F.size("holes") > 0)
        if holes:
            fill = _fill_rows(blocks, step, starts)
            counts = [_count_between("holes", o, o + k) for o, k in zip(starts.offsets, starts.ks)]
            filled = step.where("size(holes) > 0").join(fill, REC).select(
                REC, "prev", F.zip_with("spent", F.array(*counts), lambda a, b: a + b).alias("spent"),
                move("prev", "was", "stats", F.coalesce("fill", nothing)).alias("n"))
            step = cut_lineage(step.where("size(holes) = 0").select(REC, *carried).unionByName(
                filled.select(REC, "n.c", "prev", "n.done", "spent")))
            left, settled = any_of(step, still, ~still)
        step = step.select(REC, *carried)
        if settled:
            gone = step.filter(~still)
            finished = gone if finished is None else finished.unionByName(gone)
        state = step.filter(still) if settled else step
        if not left:
            break
    return (state if finished is None else finished.unionByName(state)).select(REC, "c")


@dataclass
class KMeansFit:
    """Best restart per recording and the label of every row."""

    model: DataFrame  # recording_id, centroids (flattened k x width), inertia
    labels: DataFrame  # recording_id, window_index, label


def best_restart(blocks: Blocks, fits: DataFrame, starts: Starts) -> DataFrame:
    """Lowest inertia wins, the earliest restart on ties."""
    width = blocks.width

    def cost(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, c_col in batches:
            out = []
            for x, c in zip(rows_of(x_col), rows_of(c_col)):
                d = sq_distances(x.reshape(-1, width), c.reshape(-1, width))
                out.append(np.array([d[:, list(starts.slots(m))].min(axis=1).sum()
                                     for m in range(len(starts.ks))]))
            yield list_column(out)

    parts = blocks.with_state(fits, 8 * width * sum(starts.ks) + 64).select(
        REC, F.arrow_udf(cost, "array<double>")("x", "c").alias("v"))
    pick = F.array_position("stats", F.array_min("stats")) - 1
    k = starts.ks[0]
    return fits.join(sum_vectors(parts, "v"), REC).select(
        REC,
        F.slice("c", (pick * k * width + 1).cast("int"), F.lit(k * width)).alias("centroids"),
        F.array_min("stats").alias("inertia"))


def assign_rows(blocks: Blocks, model: DataFrame, k: int) -> DataFrame:
    """Nearest centre of every row (first on ties): ``recording_id, window_index, label``."""
    width = blocks.width

    def label(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, c_col in batches:
            out = [sq_distances(x.reshape(-1, width), c.reshape(-1, width)).argmin(axis=1)
                   for x, c in zip(rows_of(x_col), rows_of(c_col))]
            yield list_column(out).cast(pa.list_(pa.int32()))

    tagged = blocks.with_state(model.select(REC, "centroids"), 8 * width * k + 64).select(
        REC, "start_idx", F.arrow_udf(label, "array<int>")("x", "centroids").alias("l"))
    return explode_labels(tagged, "l", "label")


def explode_labels(tagged: DataFrame, column: str, name: str) -> DataFrame:
    return tagged.select(REC, "start_idx", F.posexplode(column).alias("at", name)).select(
        REC, (F.col("start_idx") + F.col("at")).alias("window_index"), name)


def kmeans(blocks: Blocks, config: ClusterConfig | None = None) -> KMeansFit:
    """K-means with shared-stream restarts."""
    cfg = config or ClusterConfig()
    starts = Starts((cfg.n_clusters,) * cfg.kmeans_restarts,
                    (cfg.random_seed,) * cfg.kmeans_restarts, shared=True)
    fits = cut_lineage(fit_kmeans(blocks, starts, cfg.kmeans_iterations))
    model = cut_lineage(best_restart(blocks, fits, starts))
    return KMeansFit(model, assign_rows(blocks, model, cfg.n_clusters))
