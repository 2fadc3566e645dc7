"""Gaussian kernels of recordings of any length, tile by tile, and the walks they define.

No kernel is ever stored: a pass over a recording computes its distances anew, in tiles of two
groups of blocks, each pair of groups once, and sums up what the pass asks for. Groups grow with
the recording up to a bound and are packed once; a tile reads its two groups where they lie.
Recordings of one block are solved within a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewave.functions.arrays import list_column, rows_of
from statewave.operators.blocks import REC, Blocks, sum_vectors
from statewave.session import cut_lineage, maybe_broadcast

#: Groups of a recording up to 12 * SIDE rows, most rows of a group, parts added up in a task, partitions of groups.
GROUPS, SIDE, BAND, PARTS = 12, 32768, 16, 48
#: Rows of a tile at a time, and columns, bits of a digit.
STRIP, CHUNK, DIGIT = 128, 1024, 16
#: Columns beside the wanted ones, largest degree, largest spread of one filtering, residual, most filterings.
EXTRA, DEGREE, SPREAD, RESIDUAL, MOST_ROUNDS = 24, 10, 1e5, 1e-10, 200
#: Fewest and most pairs drawn to bracket a median, bits of the number of its bins, largest width of the bin it is in.
FEW_DRAWN, DRAWN, BINS, NARROW = 1 << 18, 1 << 20, 14, 1e-6
#: Fewest and most landmarks, rows for each of them, what is added to their kernel's diagonal.
FEW_MARKS, MARKS, ROWS_A_MARK, RIDGE = 256, 1536, 12, 1e-8
#: Columns beside the wanted ones at the start, most corrections of the wanted ones, columns of a panel.
SPARE, MOST_STEPS, PANEL = 6, 12, 128


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances; near rows from their differences, so equal rows have distance 0."""
    nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    d = x @ y.T
    d *= -2.0
    d += nx[:, None]
    d += ny
    if not d.size:
        return d
    near = 1e-6 * (np.fmax.reduce(nx) + np.fmax.reduce(ny))  # of all pairs, so most strips need no search
    if not np.fmin.reduce(d, axis=None) <= near:
        return d
    i, j = np.nonzero(d <= near)
    close = d[i, j] <= 1e-6 * (nx[i] + ny[j])
    i, j = i[close], j[close]
    for at in range(0, len(i), 1 << 18):
        a, b = i[at:at + (1 << 18)], j[at:at + (1 << 18)]
        gap = x[a] - y[b]
        d[a, b] = np.einsum("ij,ij->i", gap, gap)
    return d


def strips(x: np.ndarray, ys: list[np.ndarray]) -> Iterator[tuple[slice, int, np.ndarray]]:
    """(rows of x, number of y, squared distances) for a few rows at a time."""
    for at in range(0, len(x), STRIP):
        rows = slice(at, min(at + STRIP, len(x)))
        for k, y in enumerate(ys):
            yield rows, k, squared(x[rows], y)


def products(x: np.ndarray, ys: list[np.ndarray], factor: float) -> Iterator[tuple[slice, int, np.ndarray, int]]:
    """(rows of x, number of y, ``factor`` times the squared distances, how many are 0) as ``strips`` gives them.

    The norms and the factor go into the one matrix product. The array is used again for the next strip.
    """
    nx = np.einsum("ij,ij->i", x, x)
    left = np.column_stack([x * (-2.0 * factor), nx * factor, np.full(len(x), factor)])
    rights = [(np.column_stack([y, np.ones(len(y)), ny]).T, ny, np.fmax.reduce(ny, initial=0.0))
              for y, ny in ((y, np.einsum("ij,ij->i", y, y)) for y in ys)]
    room = np.empty(STRIP * max((len(y) for y in ys), default=0))
    for at in range(0, len(x), STRIP):
        rows = slice(at, min(at + STRIP, len(x)))
        own, most_x = nx[rows], np.fmax.reduce(nx[rows], initial=0.0)
        for k, (right, ny, most_y) in enumerate(rights):
            d = room[:len(own) * len(ny)].reshape(len(own), len(ny))
            np.dot(left[rows], right, out=d)
            zeros, near = 0, 1e-6 * (most_x + most_y) * factor
            low = d.size and (np.fmax if factor < 0 else np.fmin).reduce(d, axis=None)
            if d.size and (low >= near if factor < 0 else low <= near):
                i, j = np.nonzero(d >= near if factor < 0 else d <= near)
                close = d[i, j] / factor <= 1e-6 * (own[i] + ny[j])
                i, j = i[close], j[close]
                for a in range(0, len(i), 1 << 18):
                    p, q = i[a:a + (1 << 18)], j[a:a + (1 << 18)]
                    gap = x[rows][p] - ys[k][q]
                    exact = np.einsum("ij,ij->i", gap, gap)
                    zeros += len(exact) - np.count_nonzero(exact)
                    d[p, q] = exact * factor
            yield rows, k, d, zeros


def kernel_of(x: np.ndarray, z: np.ndarray, epsilon: float) -> np.ndarray:
    """The kernel between the rows of x and of z."""
    out = np.empty((len(x), len(z)))
    for rows, k, d, _ in products(x, chunks(z), -1.0 / epsilon):
        np.exp(d, out=out[rows, k * CHUNK:(k + 1) * CHUNK])
    return out


def kernel_times(x: np.ndarray, ys: list[np.ndarray], vs: list[np.ndarray], epsilon: float) -> np.ndarray:
    """Rows of the kernel between x and all ys, times the vs."""
    out = np.zeros((len(x), vs[0].shape[1]))
    for rows, k, d in strips(x, ys):
        out[rows] += np.exp(-d / epsilon) @ vs[k]
    return out


def median_of(x: np.ndarray) -> float:
    """Median of the positive squared distances between all rows; 1 if there are none."""
    d = np.concatenate([d[d > 0] for _, _, d in strips(x, [x])])
    return float(np.median(d)) if len(d) else 1.0


def group_blocks(blocks: Blocks) -> int:
    """Blocks of a group: one side of a tile."""
    rows = min(SIDE, -(-blocks.max_blocks * blocks.size // GROUPS))
    return max(1, rows // blocks.size)


def sides(blocks: Blocks) -> DataFrame:
    """``recording_id, side, blocks, rows, x``: each group packed in one row, kept for all passes."""
    grouped = blocks.df.groupBy(REC, F.expr(f"int(block div {group_blocks(blocks)})").alias("side")).agg(
        F.sort_array(F.collect_list(F.struct("block", "x"))).alias("p"))
    rows = F.transform("p", lambda p: (F.size(p["x"]) / blocks.width).cast("int"))
    return cut_lineage(dealt(blocks, grouped.select(
        REC, "side", F.col("p.block").alias("blocks"), rows.alias("rows"), F.flatten("p.x").alias("x"))))


def dealt(blocks: Blocks, packed: DataFrame) -> DataFrame:
    """Groups one to a partition, or a few if there are more than ``PARTS``."""
    groups = blocks.n_recordings * -(-blocks.max_blocks // group_blocks(blocks))
    parts = max(1, min(groups, PARTS))
    return packed.repartitionById(parts, F.expr(f"int(pmod(hash({REC}) + side, {parts}))"))


def tiled(blocks: Blocks, columns: DataFrame | None, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
          state: DataFrame | None = None, state_bytes: int = 64, packed: DataFrame | None = None) -> DataFrame:
    """``fn(blocks of a group, blocks of the same or a later group)`` for every two groups of a recording.

    ``columns`` (recording, block, v) come beside ``x``; ``state`` has a row per recording. The
    number of the group is ``side``. Tasks read the two groups of a tile from ``packed``, the ``sides``,
    where they lie, so no shuffle deals a group to as many places as there are groups.
    """
    width, packed, extra = blocks.width, sides(blocks) if packed is None else packed, []
    if columns is not None:
        beside = columns.groupBy(REC, F.expr(f"int(block div {group_blocks(blocks)})").alias("side")).agg(
            F.sort_array(F.collect_list(F.struct("block", "v"))).alias("p")).select(REC, "side", F.flatten("p.v").alias("v"))
        packed, extra = dealt(blocks, packed.join(beside, [REC, "side"])), ["v"]
    names = ["side", "blocks", "rows", "x", *extra]
    first = packed.select(REC, *[F.col(c).alias(f"{c}_i") for c in names])
    second = packed.select(F.col(REC).alias("_other"), *[F.col(c).alias(f"{c}_j") for c in names])
    pairs = first.hint("shuffle_replicate_nl").join(
        second, (F.col(REC) == F.col("_other")) & (F.col("side_i") <= F.col("side_j"))).drop("_other")
    known = [] if state is None else [c for c in state.columns if c != REC]
    if state is not None:
        pairs = pairs.join(maybe_broadcast(state, blocks.n_recordings, state_bytes), REC)

    def group(row: dict, s: str) -> pd.DataFrame:
        ends = np.cumsum(row[f"rows_{s}"])[:-1]
        cells = {"x": np.split(row[f"x_{s}"], ends * width)}
        for c in extra:
            cells[c] = np.split(row[f"{c}_{s}"], ends * (len(row[f"{c}_{s}"]) // np.sum(row[f"rows_{s}"])))
        return pd.DataFrame({REC: row[REC], "i": row["side_i"], "j": row["side_j"], "side": row[f"side_{s}"],
                             "block": row[f"blocks_{s}"], **cells, **{c: row[c] for c in known}})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                yield fn(group(row, "i"), group(row, "j"))

    return pairs.mapInPandas(run, schema)


def stacked(rows: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, dtype=float) for v in rows]).reshape(-1, width)


def chunks(x: np.ndarray) -> list[np.ndarray]:
    return [x[at:at + CHUNK] for at in range(0, len(x), CHUNK)]


def digits_of(d: np.ndarray, step: int, prefix: int) -> np.ndarray:
    """How often each digit number ``step`` follows the digits ``prefix`` in the bits of positive numbers.

    Doubles are compared as numbers, so only those with the prefix are taken out.
    """
    shift = 64 - DIGIT * (step + 1)
    if step == 0:
        n = np.bincount((d.view(np.uint64) >> np.uint64(shift)).view(np.int64).ravel(), minlength=1 << DIGIT)
        n[0] -= d.size - np.count_nonzero(d)
        n[0x7FF8:] = 0  # neither a number nor positive
        return n
    low, high = np.array([prefix, prefix + 1], dtype=np.uint64) << np.uint64(shift + DIGIT)
    low, high = np.maximum(low, np.uint64(1)).view(float), high.view(float)
    here = d >= low
    if high == high:  # above the last numbers there is no bound
        here &= d < high
    bits = d[here].view(np.uint64) >> np.uint64(shift)
    return np.bincount((bits & np.uint64((1 << DIGIT) - 1)).view(np.int64), minlength=1 << DIGIT)


def median_distances(blocks: Blocks, packed: DataFrame | None = None) -> DataFrame:
    """``recording_id, epsilon``: the median of all positive squared distances, exactly.

    The order of positive doubles is that of their bits, so four passes settle the two middle
    values, 16 bits each, from the numbers of distances by those bits. Distances between two
    groups count twice, as those within a group do.
    """
    width, digits = blocks.width, 1 << DIGIT
    packed = sides(blocks) if packed is None else packed

    def count(step: int) -> Callable[[pd.Series, pd.DataFrame], pd.DataFrame]:
        def run(own: pd.DataFrame, band: pd.DataFrame) -> pd.DataFrame:
            one = own.iloc[0]
            both = one["low"] == one["high"]
            n = np.zeros((2, digits), dtype=np.int64)
            prefixes = [one["low"], one["high"]][:1 if both else 2]
            for _, _, d in strips(stacked(own["x"], width), chunks(stacked(band["x"], width))):
                for side, prefix in enumerate(prefixes):
                    n[side] += digits_of(d, step, int(prefix))
            if both:
                n[1] = n[0]
            side, digit = np.nonzero(n)
            times = 1 if one["side"] == band["side"].iloc[0] else 2
            return pd.DataFrame({REC: one[REC], "side": side, "digit": digit, "n": times * n[side, digit]})
        return run

    zero = F.lit(0).cast("bigint")
    state = blocks.lengths.select(REC, zero.alias("low"), zero.alias("high"), zero.alias("rank_low"), zero.alias("rank_high"))
    for step in range(64 // DIGIT):
        found = tiled(blocks, None, count(step), f"{REC} string, side int, digit bigint, n bigint", state, packed=packed).groupBy(
            REC, "side", "digit").agg(F.sum("n").alias("n"))
        side = Window.partitionBy(REC, "side")  # at most 2^16 digits
        found = found.withColumn("upto", F.sum("n").over(side.orderBy("digit"))).withColumn("total", F.sum("n").over(side))
        found = found.join(maybe_broadcast(state, blocks.n_recordings, 64), REC)
        rank = F.when(F.col("side") == 0, F.col("rank_low")).otherwise(F.col("rank_high"))
        if step == 0:  # all positive distances, each of them twice
            rank = F.when(F.col("side") == 0, F.expr("(total - 1) div 2")).otherwise(F.expr("total div 2"))
        prefix = F.when(F.col("side") == 0, F.col("low")).otherwise(F.col("high"))
        hit = found.withColumn("rank", rank).where("upto > rank and upto - n <= rank").select(
            REC, "side", (prefix * digits + F.col("digit")).alias("prefix"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
        pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
        state = cut_lineage(hit.groupBy(REC).agg(pick(0, "prefix").alias("low"), pick(1, "prefix").alias("high"),
                                                 pick(0, "rank").alias("rank_low"), pick(1, "rank").alias("rank_high")))

    def middle(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for low, high in batches:
            yield pa.array((low.to_numpy().view(float) + high.to_numpy().view(float)) / 2)

    found = state.select(REC, F.arrow_udf(middle, "double")("low", "high").alias("epsilon"))
    return blocks.lengths.select(REC).join(found, REC, "left").select(REC, F.coalesce("epsilon", F.lit(1.0)).alias("epsilon"))


def by_block(rows: pd.DataFrame, other: int, total: np.ndarray, width: int) -> pd.DataFrame:
    """What a tile found for the ``rows`` of one of its groups, as ``recording_id, block, band, v``."""
    ends = np.cumsum([len(x) // width for x in rows["x"]])[:-1]
    return pd.DataFrame({REC: rows[REC], "block": rows["block"], "band": other, "v": [p.ravel() for p in np.split(total, ends)]})


def total_rows(parts: DataFrame, groups: int) -> DataFrame:
    """Sums of the flat arrays of each block, one for each group: ``recording_id, block, v``."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(v=[np.sum(np.stack(pdf["v"].to_list()), axis=0)])

    schema = f"{REC} string, block bigint, v array<double>"
    if groups > BAND:
        parts = parts.withColumn("part", F.expr(f"band div {BAND}")).groupBy(REC, "block", "part").applyInPandas(
            lambda pdf: add(pdf)[[REC, "block", "part", "v"]], f"{REC} string, block bigint, part bigint, v array<double>")
    return parts.groupBy(REC, "block").applyInPandas(lambda pdf: add(pdf)[[REC, "block", "v"]], schema)


def applied(blocks: Blocks, packed: DataFrame, vectors: DataFrame, scales: DataFrame, columns: int) -> DataFrame:
    """``recording_id, block, v``: the kernel times the ``vectors`` of all blocks, row-major."""
    width = blocks.width

    def tile(own: pd.DataFrame, band: pd.DataFrame) -> pd.DataFrame:
        epsilon, i, j = own["epsilon"].iloc[0], own["side"].iloc[0], band["side"].iloc[0]
        x, v = stacked(own["x"], width), stacked(own["v"], columns)
        ys, us = ([chunks(stacked(band[c], k)) for c, k in (("x", width), ("v", columns))])
        out, back = np.zeros((len(x), columns)), [np.zeros(u.shape) for u in us]
        for rows, k, d, _ in products(x, ys, -1.0 / epsilon):
            near = np.exp(d, out=d)
            out[rows] += near @ us[k]
            if i != j:
                back[k] += near.T @ v[rows]
        found = [(own, j, out)] + ([(band, i, np.concatenate(back))] if i != j else [])
        return pd.concat([by_block(rows, other, total, width) for rows, other, total in found])

    parts = tiled(blocks, vectors, tile, f"{REC} string, block bigint, band int, v array<double>", scales, packed=packed)
    return total_rows(parts, -(-blocks.max_blocks // group_blocks(blocks)))


def widths(blocks: Blocks, packed: DataFrame, epsilon: float | None) -> DataFrame:
    """``recording_id, epsilon`` of recordings of several blocks."""
    found = median_distances(blocks, packed) if epsilon is None else blocks.lengths.select(REC, F.lit(float(epsilon)).alias("epsilon"))
    return cut_lineage(found.select(REC, F.greatest("epsilon", F.lit(1e-6)).alias("epsilon")))


def long_row_sums(blocks: Blocks, packed: DataFrame, scales: DataFrame) -> DataFrame:
    ones = blocks.df.select(REC, "block", F.transform(F.sequence(
        F.lit(1), F.expr(f"int(size(x) / {blocks.width})")), lambda i: F.lit(1.0)).alias("v"))
    return cut_lineage(applied(blocks, packed, ones, scales, 1).withColumnRenamed("v", "row_sum"))


# --- median and row sums in two passes --------------------------------------------------------

def bits_of(value: float) -> int:
    return int(np.float64(value).view(np.uint64))


def double_of(bits: int) -> float:
    return float(np.uint64(bits).view(np.float64))


def bracket_of(drawn: np.ndarray) -> dict | None:
    """Bins around the median of all numbers, by the bits of some: number of the first, bits dropped, count, bounds.

    Six deviations wide, so it misses the median about once in 10^9 times. None if there are too few numbers.
    """
    drawn = np.sort(drawn)
    gap = 3.0 * np.sqrt(len(drawn)) + 2
    low, high = int(np.floor(len(drawn) / 2 - gap)), int(np.ceil(len(drawn) / 2 + gap))
    if low < 0 or high >= len(drawn):
        return None
    low, high = bits_of(drawn[low] * (1 - 1e-8)), bits_of(drawn[high] * (1 + 1e-8))
    shift = max(0, (high - low).bit_length() - BINS)
    base, last = low >> shift, high >> shift
    bounds = double_of(base << shift), double_of((last + 1) << shift)
    if bounds[0] <= 1e-6 or not np.isfinite(bounds[1]):
        return None
    return {"base": base, "shift": shift, "bins": last - base + 1, "low": bounds[0], "high": bounds[1]}


BRACKET = "base bigint, shift int, bins int, low double, high double"


def brackets(blocks: Blocks, packed: DataFrame) -> DataFrame:
    """``recording_id`` and the bins around the median of its positive squared distances, from pairs drawn evenly."""
    width = blocks.width

    def draw(own: pd.DataFrame, band: pd.DataFrame) -> pd.DataFrame:
        x, y, n = stacked(own["x"], width), stacked(band["x"], width), int(own["n_rows"].iloc[0])
        i, j = int(own["i"].iloc[0]), int(own["j"].iloc[0])
        random = np.random.Generator(np.random.PCG64([13, i, j]))
        share = len(x) * len(y) * (1 if i == j else 2) / n ** 2
        count = int(np.ceil(share * min(DRAWN, max(FEW_DRAWN, 64 * n))))
        gap = x[random.integers(0, len(x), count)] - y[random.integers(0, len(y), count)]
        d = np.einsum("ij,ij->i", gap, gap)
        return pd.DataFrame({REC: own[REC].iloc[:1], "v": [d[d > 0]]})

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        found = bracket_of(np.concatenate(pdf["v"].to_list()))
        return pd.DataFrame([{REC: pdf[REC].iloc[0], **found}] if found else [], columns=[REC, "base", "shift", "bins", "low", "high"])

    drawn = tiled(blocks, None, draw, f"{REC} string, v array<double>", blocks.lengths.select(REC, "n_rows"), packed=packed)
    return cut_lineage(drawn.groupBy(REC).applyInPandas(pick, f"{REC} string, {BRACKET}"))


def middle_bins(blocks: Blocks, packed: DataFrame, around: DataFrame) -> DataFrame:
    """``recording_id, low, high, rank_low, rank_high``: the bin of the median and the ranks of the two middle values in it.

    All pairs are counted. Recordings whose bracket missed the median, or with too wide a bin, are left out.
    """
    width = blocks.width

    def count(own: pd.DataFrame, band: pd.DataFrame) -> pd.DataFrame:
        one = own.iloc[0]
        shift, n = np.uint64(one["shift"]), np.zeros(int(one["bins"]) + 2, dtype=np.int64)
        for _, _, d, zeros in products(stacked(own["x"], width), chunks(stacked(band["x"], width)), 1.0):
            below, upto = d < one["low"], d < one["high"]
            n[-2] += np.count_nonzero(below) - zeros
            n[-1] += np.count_nonzero(d >= one["high"])
            inside = d.ravel()[np.flatnonzero(below != upto)]
            n[:-2] += np.bincount(((inside.view(np.uint64) >> shift) - np.uint64(one["base"])).view(np.int64), minlength=len(n) - 2)
        return pd.DataFrame({REC: [one[REC]], "i": [one["i"]], "n": [n * (1 if one["i"] == one["j"] else 2)], **{
            c: [one[c]] for c in ("base", "shift", "bins")}})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(n=[np.sum(np.stack(pdf["n"].to_list()), axis=0)])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        one = add(pdf).iloc[0]
        n, below, total = one["n"][:-2], int(one["n"][-2]), int(one["n"].sum())
        ranks = [(total - 1) // 2 - below, total // 2 - below]
        upto = np.cumsum(n)
        rows = []
        if 0 <= ranks[0] and ranks[1] < upto[-1]:
            first, last = (int(np.searchsorted(upto, r, side="right")) for r in ranks)
            low, high = (double_of((int(one["base"]) + k) << int(one["shift"])) for k in (first, last + 1))
            if high - low <= NARROW * low:
                before = int(upto[first] - n[first])
                rows = [{REC: one[REC], "low": low, "high": high, "rank_low": ranks[0] - before, "rank_high": ranks[1] - before}]
        return pd.DataFrame(rows, columns=[REC, "low", "high", "rank_low", "rank_high"])

    schema = f"{REC} string, i int, n array<bigint>, base bigint, shift int, bins int"
    found = tiled(blocks, None, count, schema, around, packed=packed)
    return cut_lineage(found.groupBy(REC, "i").applyInPandas(add, schema).groupBy(REC).applyInPandas(
        pick, f"{REC} string, low double, high double, rank_low bigint, rank_high bigint"))


def sums_and_median(blocks: Blocks, packed: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``recording_id, epsilon`` and ``recording_id, block, row_sum`` of recordings with a known bin of the median.

    One pass takes the distances in the bin, which settle the median, and sums up the kernel for the bin's middle with
    its derivative: the bin is so narrow that the next term is below the rounding of the sums.
    """
    width = blocks.width

    def tile(own: pd.DataFrame, band: pd.DataFrame) -> pd.DataFrame:
        one = own.iloc[0]
        low, high, i, j = one["low"], one["high"], one["i"], one["j"]
        middle = (low + high) / 2
        x, ys = stacked(own["x"], width), chunks(stacked(band["x"], width))
        out, back, kept, few = np.zeros((len(x), 2)), [np.zeros((len(y), 2)) for y in ys], [np.zeros((0, 2))], 0
        near, ones = np.empty(STRIP * CHUNK), np.ones(max(STRIP, CHUNK))
        for rows, k, d, _ in products(x, ys, 1.0):
            here = d.ravel()[np.flatnonzero((d < low) != (d < high))]
            if len(here):
                value, times = np.unique(here, return_counts=True)
                kept.append(np.column_stack([value, times]))
                few += len(value)
                if few > 1 << 20:
                    kept = [merged(np.concatenate(kept))]
                    few = 0
            e = near[:d.size].reshape(d.shape)
            np.exp(np.multiply(d, -1.0 / middle, out=e), out=e)
            np.multiply(d, e, out=d)
            out[rows, 0] += e @ ones[:d.shape[1]]
            out[rows, 1] += d @ ones[:d.shape[1]]
            if i != j:
                back[k][:, 0] += ones[:len(d)] @ e
                back[k][:, 1] += ones[:len(d)] @ d
        kept = merged(np.concatenate(kept)) * (1, 1 if i == j else 2)
        found = [by_block(own, j, out, width)] + ([by_block(band, i, np.concatenate(back), width)] if i != j else [])
        return pd.concat([*found, pd.DataFrame({REC: [one[REC]], "block": [-1], "band": [j], "v": [kept.ravel()]})])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        one, kept = pdf.iloc[0], merged(np.concatenate([np.reshape(v, (-1, 2)) for v in pdf["v"]]))
        at = np.searchsorted(np.cumsum(kept[:, 1]), [one["rank_low"], one["rank_high"]], side="right")
        values = kept[np.minimum(at, len(kept) - 1), 0]
        return pd.DataFrame({REC: [one[REC]], "epsilon": [float(values.mean())], "middle": [(one["low"] + one["high"]) / 2]})

    found = cut_lineage(tiled(blocks, None, tile, f"{REC} string, block bigint, band int, v array<double>", bins, packed=packed))
    known = cut_lineage(found.where("block < 0").select(REC, "v").join(maybe_broadcast(bins, blocks.n_recordings, 64), REC).groupBy(
        REC).applyInPandas(pick, f"{REC} string, epsilon double, middle double"))

    def at_median(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for col, epsilon, middle in batches:
            yield list_column([v.reshape(-1, 2) @ (1.0, (e / m - 1.0) / m) for v, e, m in zip(
                rows_of(col), epsilon.to_numpy(), middle.to_numpy())])

    sums = total_rows(found.where("block >= 0"), -(-blocks.max_blocks // group_blocks(blocks))).join(
        maybe_broadcast(known, blocks.n_recordings, 64), REC).select(
        REC, "block", F.arrow_udf(at_median, "array<double>")("v", "epsilon", "middle").alias("row_sum"))
    return known.select(REC, "epsilon"), cut_lineage(sums)


def merged(kept: np.ndarray) -> np.ndarray:
    """(value, times) with each value once, in order."""
    value, at = np.unique(kept[:, 0], return_inverse=True)
    return np.column_stack([value, np.bincount(at, weights=kept[:, 1], minlength=len(value))])


def scales_and_sums(blocks: Blocks, packed: DataFrame, epsilon: float | None) -> tuple[DataFrame, DataFrame]:
    """``recording_id, epsilon`` and ``recording_id, block, row_sum`` of recordings of several blocks.

    Two passes over all pairs; the median by its bits and a pass for the sums if a bracket misses a median.
    """
    if epsilon is None:
        bins = middle_bins(blocks, packed, brackets(blocks, packed))
        if bins.count() == blocks.n_recordings:
            return sums_and_median(blocks, packed, bins)
    scales = widths(blocks, packed, epsilon)
    return scales, long_row_sums(blocks, packed, scales)


# --- leading eigenvectors -------------------------------------------------------------------

def ritz(gram: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combinations of columns v with v'v = 1 and v'Av = value, largest first, from V'V and V'AV.

    Columns that depend on the others come out as zeros with value 0.
    """
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    w, u = np.linalg.eigh(gram * np.outer(scale, scale))
    good = w > 1e-13 * w[-1]
    basis = scale[:, None] * u[:, good] / np.sqrt(w[good])
    value, s = np.linalg.eigh(basis.T @ ((cross + cross.T) / 2) @ basis)
    s, value = basis @ s[:, ::-1], value[::-1]
    missing = len(gram) - len(value)
    return np.pad(s, ((0, 0), (0, missing))), np.pad(value, (0, missing))


def degree_for(value: np.ndarray, wanted: int) -> tuple[int, float]:
    """Degree of the next filter and the end of the interval [0, end] that it damps.

    So high a degree that the largest value doesn't drown the last wanted one.
    """
    end = max(float(value[-1]), 1e-3 * float(value[min(wanted, len(value) - 1)]), 1e-12)
    growth = [np.arccosh(max(2 * float(value[k]) / end - 1, 1 + 1e-9)) for k in (0, min(wanted, len(value) - 1))]
    gap = growth[0] - growth[1]
    return int(np.clip(np.log(SPREAD) / gap if gap > 0 else DEGREE, 1, DEGREE)), end


def filtered(step: Callable, v, w, degree: int, end: float):
    """Chebyshev polynomial of A over [0, end] on v, given w = A v; ``step(a, b, c)`` is 2 (2 A a / end - a) - b or, first, half of it."""
    before, now = v, step(w, None, v, end)
    for _ in range(degree - 1):
        before, now = now, step(None, before, now, end)
    return now


def start_vectors(n: int, columns: int, block: int, root: np.ndarray) -> np.ndarray:
    v = np.random.Generator(np.random.PCG64([7, block])).normal(size=(n, columns))
    v[:, 0] = root
    return v


def local_walk(x: np.ndarray, wanted: int, epsilon: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvectors and values 2 to ``wanted`` + 1 of the walk over the rows of one block, and its row sums."""
    epsilon = max(median_of(x) if epsilon is None else epsilon, 1e-6)
    kernel = np.concatenate([np.exp(-d / epsilon) for _, _, d in strips(x, [x])]) if len(x) else np.empty((0, 0))
    sums = kernel.sum(axis=1)
    root = np.sqrt(np.maximum(sums, 1e-12))
    walk = kernel / np.outer(root, root)
    v = start_vectors(len(x), min(wanted + 1 + EXTRA, len(x)), 0, root)

    def step(w, before, now, end):
        image = walk @ now if w is None else w
        return 2 * image / end - now if before is None else 2 * (2 * image / end - now) - before

    for _ in range(MOST_ROUNDS):
        w = walk @ v
        s, value = ritz(v.T @ v, v.T @ w)
        v, w = v @ s, w @ s
        if np.sqrt(((w - v * value)[:, :wanted + 1] ** 2).sum(axis=0)).max() <= RESIDUAL:
            break
        degree, end = degree_for(value, wanted)
        v = filtered(step, v, w, degree, end)
    return v[:, 1:wanted + 1] / root[:, None], value[1:wanted + 1], sums


def marks_of(n: int) -> int:
    """Landmarks of a recording of ``n`` rows."""
    return min(n, max(FEW_MARKS, min(MARKS, n // ROWS_A_MARK)))


class Walk:
    """The same vectors of recordings of several blocks: vectors lie in ``recording_id, block, v`` tables.

    The kernel between all rows and some landmarks defines a walk of low rank, whose eigenvectors are the start
    and which turns residuals into corrections. It only steers: every image is one under the whole walk, a
    pass over all pairs, and so are the residuals that end the search. If the landmarks leave too much of the
    walk out, or the corrections do not end, filtering goes on as within one block.
    """

    def __init__(self, blocks: Blocks, wanted: int, epsilon: float | None):
        self.blocks, self.wanted, self.columns = blocks, wanted, wanted + 1 + EXTRA
        self.packed = sides(blocks)
        self.scales, self.sums = scales_and_sums(blocks, self.packed, epsilon)

    def rooted(self, vectors: DataFrame) -> DataFrame:
        """Vectors divided by the square roots of the row sums."""
        def divide(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for v, sums in batches:
                yield list_column([(a.reshape(len(s), -1) / np.sqrt(np.maximum(s, 1e-12))[:, None]).ravel()
                                   for a, s in zip(rows_of(v), rows_of(sums))])

        return vectors.join(self.sums, [REC, "block"]).select(
            REC, "block", F.arrow_udf(divide, "array<double>")("v", "row_sum").alias("v"))

    def image(self, vectors: DataFrame, columns: int) -> DataFrame:
        """The symmetric walk times ``vectors``: one pass over all tiles."""
        return self.rooted(applied(self.blocks, self.packed, self.rooted(vectors), self.scales, columns))

    def laid(self) -> DataFrame:
        """``recording_id, block, n_rows, x, row_sum, epsilon``, the blocks of a group in one partition."""
        blocks = self.blocks
        rows = blocks.df.select(REC, "block", "n_rows", "x").join(self.sums, [REC, "block"]).join(
            maybe_broadcast(self.scales, blocks.n_recordings, 64), REC)
        side = F.expr(f"int(block div {group_blocks(blocks)})")
        return cut_lineage(dealt(blocks, rows.withColumn("side", side)).drop("side").sortWithinPartitions(REC, "block"))

    def marks(self, laid: DataFrame) -> DataFrame:
        """``recording_id, z, scale``: landmarks, drawn with weights of one over the row sums, so rows far from others come first."""
        width = self.blocks.width

        def best(key: np.ndarray, z: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
            first = np.argsort(key, kind="stable")[:marks_of(n)]
            return [key[first]], [z[first].ravel()]

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for row in pdf.to_dict("records"):
                    random = np.random.Generator(np.random.PCG64([11, row["block"]]))
                    key = random.exponential(size=len(row["row_sum"])) * row["row_sum"]
                    keys, z = best(key, row["x"].reshape(-1, width), row["n_rows"])
                    yield pd.DataFrame({REC: row[REC], "block": row["block"], "n_rows": row["n_rows"],
                                        "scale": row["epsilon"], "keys": keys, "z": z})

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block")
            keys, z = best(np.concatenate(pdf["keys"].to_list()), stacked(pdf["z"], width), int(pdf["n_rows"].iloc[0]))
            return pdf.iloc[:1].assign(keys=keys, z=z)[[REC, "block", "n_rows", "scale", "keys", "z"]]

        schema = f"{REC} string, block bigint, n_rows bigint, scale double, keys array<double>, z array<double>"
        drawn = laid.select(REC, "block", "n_rows", "x", "row_sum", "epsilon").mapInPandas(draw, schema).groupBy(
            REC, F.expr(f"block div {BAND}").alias("part")).applyInPandas(meet, schema)
        return cut_lineage(drawn.groupBy(REC).applyInPandas(meet, schema).select(REC, "z", "scale"))

    def by_marks(self, rows: DataFrame, state: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """``fn(recording, (row, rooted kernel between the row's block and the landmarks) of its blocks)`` for what lies together."""
        width, blocks = self.blocks.width, self.blocks

        def near(row: dict) -> tuple[dict, np.ndarray]:
            kernel = kernel_of(row["x"].reshape(-1, width), row["z"].reshape(-1, width), row["epsilon"])
            return row, kernel / np.sqrt(np.maximum(row["row_sum"], 1e-12))[:, None]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            records = (row for pdf in frames for row in pdf.to_dict("records"))
            for recording, some in groupby(records, key=lambda row: row[REC]):
                yield from fn(recording, map(near, some))

        state_bytes = 8 * MARKS * (width + self.wanted + 1 + SPARE)
        return rows.join(maybe_broadcast(state, blocks.n_recordings, state_bytes), REC).mapInPandas(run, schema)

    def steering(self, laid: DataFrame, marks: DataFrame) -> DataFrame:
        """``recording_id, turn, value, first, missed``: the eigenvectors of the walk of low rank as combinations of
        the landmarks' columns, its values, the first vectors alone and the trace that it leaves out."""
        width, lead = self.blocks.width, self.wanted + 1 + SPARE

        def moments(recording: str, pairs: Iterator[tuple[dict, np.ndarray]]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for _, near in pairs:
                total = total + near.T @ near
            for at in range(0, len(total), PANEL):
                yield pd.DataFrame({REC: [recording], "panel": [at // PANEL], "v": [total[at:at + PANEL].ravel()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = pdf["v"].iloc[0].copy()
            for v in pdf["v"].iloc[1:]:
                total += v
            return pdf.iloc[:1].assign(v=[total])

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            one = pdf.iloc[0]
            z = one["z"].reshape(-1, width)
            moment = np.concatenate(pdf.sort_values("panel")["v"].to_list()).reshape(len(z), len(z))
            low = np.linalg.cholesky(kernel_of(z, z, one["scale"]) + RIDGE * np.eye(len(z)))
            gram = np.linalg.solve(low, np.linalg.solve(low, moment).T)
            value, u = np.linalg.eigh((gram + gram.T) / 2)
            value, turn = value[::-1], np.linalg.solve(low.T, u[:, ::-1])
            first = np.zeros((len(z), lead))
            good = min(lead, int((value > 1e-12 * value[0]).sum()))
            first[:, :good] = turn[:, :good] / np.sqrt(value[:good])
            return pd.DataFrame({REC: [one[REC]], "turn": [turn.ravel()], "value": [value], "first": [first.ravel()],
                                 "missed": [one["trace"] - value.sum()]})

        panels = self.by_marks(laid, marks, moments, f"{REC} string, panel int, v array<double>").groupBy(
            REC, "panel").applyInPandas(add, f"{REC} string, panel int, v array<double>")
        trace = self.sums.groupBy(REC).agg(F.sum(F.expr(
            "aggregate(row_sum, 0D, (a, s) -> a + 1 / greatest(s, 1e-12D))")).alias("trace"))
        return cut_lineage(panels.join(marks, REC).join(trace, REC).groupBy(REC).applyInPandas(
            solve, f"{REC} string, turn array<double>, value array<double>, first array<double>, missed double"))

    def started(self, laid: DataFrame, marks: DataFrame, steering: DataFrame) -> DataFrame:
        """The constant vector of the walk and the leading ones of the walk of low rank."""
        def spread(recording: str, pairs: Iterator[tuple[dict, np.ndarray]]) -> Iterator[pd.DataFrame]:
            for row, near in pairs:
                v = near @ row["first"].reshape(near.shape[1], -1)
                v[:, 0] = np.sqrt(np.maximum(row["row_sum"], 1e-12))
                yield pd.DataFrame({REC: [recording], "block": [row["block"]], "v": [v.ravel()]})

        return cut_lineage(self.by_marks(laid, marks.join(steering.select(REC, "first"), REC), spread,
                                         f"{REC} string, block bigint, v array<double>"))

    def corrections(self, pair: DataFrame, laid: DataFrame, marks: DataFrame, steering: DataFrame) -> DataFrame:
        """Residuals of the wanted vectors, divided by the distances of their values to those of the walk of low rank.

        Its leading vectors span part of the search space from the start, so they take no part.
        """
        wanted, lead = self.wanted, self.wanted + 1 + SPARE
        rows = laid.drop("n_rows").join(pair, [REC, "block"])

        def gaps(row: dict) -> np.ndarray:
            v, w = (row[c].reshape(len(row["row_sum"]), -1)[:, 1:wanted + 1] for c in ("v", "w"))
            return w - v * row["value"][1:wanted + 1]

        def project(recording: str, pairs: Iterator[tuple[dict, np.ndarray]]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for row, near in pairs:
                total, value = total + near.T @ gaps(row), row["value"][1:wanted + 1]
            yield pd.DataFrame({REC: [recording], "h": [total.ravel()], "goal": [value]})

        def divide(pdf: pd.DataFrame) -> pd.DataFrame:
            one = pdf.iloc[0]
            turn = one["turn"].reshape(len(one["value"]), -1)
            h = np.sum(np.stack(pdf["h"].to_list()), axis=0).reshape(len(turn), wanted)
            below = np.maximum(one["goal"] - one["value"][:, None], 0.05 * np.abs(one["goal"]) + 1e-12)
            share = turn.T @ h / below
            share[:lead] = 0
            return pd.DataFrame({REC: [one[REC]], "q": [(turn @ share).ravel()]})

        def correct(recording: str, pairs: Iterator[tuple[dict, np.ndarray]]) -> Iterator[pd.DataFrame]:
            for row, near in pairs:
                v = gaps(row) + near @ row["q"].reshape(-1, wanted)
                yield pd.DataFrame({REC: [recording], "block": [row["block"]], "v": [v.ravel()]})

        parts = self.by_marks(rows, marks, project, f"{REC} string, h array<double>, goal array<double>")
        found = cut_lineage(parts.groupBy(REC).applyInPandas(
            lambda pdf: pdf.iloc[:1].assign(h=[np.sum(np.stack(pdf["h"].to_list()), axis=0)]),
            f"{REC} string, h array<double>, goal array<double>").join(
            steering.select(REC, "turn", F.col("value")), REC).groupBy(REC).applyInPandas(divide, f"{REC} string, q array<double>"))
        return cut_lineage(self.by_marks(rows, marks.join(found, REC), correct, f"{REC} string, block bigint, v array<double>"))

    def widened(self, pair: DataFrame, more: DataFrame, columns: int) -> DataFrame:
        """The pair with the vectors ``more`` and their images beside its own."""
        def beside(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for a, b, sums in batches:
                yield list_column([np.hstack([p.reshape(len(s), -1), q.reshape(len(s), -1)]).ravel()
                                   for p, q, s in zip(rows_of(a), rows_of(b), rows_of(sums))])

        both = F.arrow_udf(beside, "array<double>")
        rows = pair.select(REC, "block", "v", "w").join(more.withColumnRenamed("v", "more"), [REC, "block"]).join(
            self.image(more, columns).withColumnRenamed("v", "image"), [REC, "block"]).join(self.sums, [REC, "block"])
        return rows.select(REC, "block", both("v", "more", "row_sum").alias("v"), both("w", "image", "row_sum").alias("w"))

    def padded(self, pair: DataFrame) -> DataFrame:
        """As many of the pair's vectors as a filter takes, and random ones in the place of missing ones."""
        columns = self.columns

        def draw(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for v, sums, block in batches:
                out = []
                for a, s, b in zip(rows_of(v), rows_of(sums), block.to_pylist()):
                    a = a.reshape(len(s), -1)[:, :columns]
                    new = start_vectors(len(s), columns, b, np.sqrt(np.maximum(s, 1e-12)))
                    new[:, :a.shape[1]] = a
                    out.append(new.ravel())
                yield list_column(out)

        return cut_lineage(pair.join(self.sums, [REC, "block"]).select(
            REC, "block", F.arrow_udf(draw, "array<double>")("v", "row_sum", "block").alias("v")))

    def both(self, v: DataFrame, w: DataFrame) -> DataFrame:
        return v.join(w.withColumnRenamed("v", "w"), [REC, "block"])

    def rotated(self, pair: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(recording, block, v, w) with the k columns turned to Ritz vectors, and each recording's values."""
        def grams(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for v, w in batches:
                yield list_column([np.concatenate([(a.T @ a).ravel(), (a.T @ b).ravel()]) for a, b in (
                    (p.reshape(-1, k), q.reshape(-1, k)) for p, q in zip(rows_of(v), rows_of(w)))])

        def solve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for stats in batches:
                found = [ritz(g[:k * k].reshape(k, k), g[k * k:].reshape(k, k)) for g in rows_of(stats)]
                yield pa.StructArray.from_arrays([list_column([s.ravel() for s, _ in found]), list_column([t for _, t in found])],
                                                 names=["turn", "value"])

        def turn(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for v, s in batches:
                yield list_column([(a.reshape(-1, k) @ b.reshape(k, k)).ravel() for a, b in zip(rows_of(v), rows_of(s))])

        pair = cut_lineage(pair)
        parts = pair.select(REC, F.arrow_udf(grams, "array<double>")("v", "w").alias("g"))
        state = cut_lineage(sum_vectors(parts, "g").select(REC, F.arrow_udf(
            solve, "struct<turn:array<double>, value:array<double>>")("stats").alias("r")).select(REC, "r.*"))
        new = F.arrow_udf(turn, "array<double>")
        out = pair.join(maybe_broadcast(state, self.blocks.n_recordings, 8 * k * (k + 1) + 64), REC).select(
            REC, "block", new("v", "turn").alias("v"), new("w", "turn").alias("w"), "value")
        return cut_lineage(out), state.select(REC, "value")

    def residual(self, pair: DataFrame, k: int) -> float:
        """Largest residual of a wanted vector of any recording."""
        wanted = self.wanted

        def gaps(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for v, w, value in batches:
                yield list_column([((b.reshape(-1, k) - a.reshape(-1, k) * t)[:, :wanted + 1] ** 2).sum(axis=0)
                                   for a, b, t in zip(rows_of(v), rows_of(w), rows_of(value))])

        parts = pair.select(REC, F.arrow_udf(gaps, "array<double>")("v", "w", "value").alias("g"))
        return float(sum_vectors(parts, "g").agg(F.max(F.array_max("stats"))).first()[0] or 0.0) ** 0.5

    def step(self, w: DataFrame | None, before: DataFrame | None, now: DataFrame, end: DataFrame) -> DataFrame:
        """One step of the filter's recursion."""
        pair = self.both(now, self.image(now, self.columns) if w is None else w).join(
            maybe_broadcast(end, self.blocks.n_recordings, 64), REC)
        if before is not None:
            pair = pair.join(before.withColumnRenamed("v", "u"), [REC, "block"])

        def advance(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for v, image, ends, *old in batches:
                new = [2 * b / e - a for a, b, e in zip(rows_of(v), rows_of(image), ends.to_numpy())]
                yield list_column([2 * n - u for n, u in zip(new, rows_of(old[0]))] if old else new)

        names = ["v", "w", "end"] + (["u"] if before is not None else [])
        return cut_lineage(pair.select(REC, "block", F.arrow_udf(advance, "array<double>")(*names).alias("v")))

    def steered(self) -> tuple[DataFrame, DataFrame, int, bool]:
        """(recording, block, v, w), values, number of columns and whether the wanted vectors are found."""
        k, wanted = self.wanted + 1 + SPARE, self.wanted
        laid = self.laid()
        marks = self.marks(laid)
        steering = self.steering(laid, marks)
        v = self.started(laid, marks, steering)
        pair, values = self.rotated(self.both(v, self.image(v, k)), k)
        unsure = values.join(steering.select(REC, "missed"), REC).where(F.col("missed") > F.col("value")[wanted] / 2)
        if unsure.count():  # what the landmarks leave out could hold a wanted vector
            return pair, values, k, False
        for _ in range(MOST_STEPS):
            if self.residual(pair, k) <= RESIDUAL:
                return pair, values, k, True
            more = self.corrections(pair, laid, marks, steering)
            pair, values = self.rotated(self.widened(pair, more, wanted), k + wanted)
            k += wanted
        return pair, values, k, self.residual(pair, k) <= RESIDUAL

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(recording, block, psi) of the eigenvectors 2 to ``wanted`` + 1 of the walk, and (recording, values)."""
        wanted = self.wanted

        def plan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for value in batches:
                degrees = [degree_for(t, wanted) for t in rows_of(value)]
                yield pa.StructArray.from_arrays([pa.array([d for d, _ in degrees], pa.int32()), pa.array([e for _, e in degrees])],
                                                 names=["degree", "end"])

        pair, values, k, found = self.steered()
        if not found:
            k, v = self.columns, self.padded(pair)
            for turn in range(MOST_ROUNDS):
                pair, values = self.rotated(self.both(v, self.image(v, k)), k)
                if turn and self.residual(pair, k) <= RESIDUAL:  # random vectors count after a filtering
                    break
                ends = cut_lineage(values.select(REC, F.arrow_udf(plan, "struct<degree:int, end:double>")("value").alias("p")).select(REC, "p.*"))
                degree = ends.agg(F.min("degree")).first()[0]
                v = filtered(self.step, pair.select(REC, "block", "v"), pair.select(REC, "block", F.col("w").alias("v")),
                             degree, ends.select(REC, "end"))

        def picked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for col in batches:
                yield list_column([np.ascontiguousarray(a.reshape(-1, k)[:, 1:wanted + 1]).ravel() for a in rows_of(col)])

        out = self.rooted(pair.select(REC, "block", "v")).select(REC, "block", F.arrow_udf(picked, "array<double>")("v").alias("psi"))
        return out, values.select(REC, F.slice("value", 2, wanted).alias("eigenvalues"))
