"""Zero-phase filtering of recordings of any length.

A recording is a chain of blocks. The forward and the backward pass are linear, so a block
only needs the state that enters it from each side. One pass over the blocks measures how
every block answers from rest, a scan over those small answers gives the entering states,
and a second pass produces the samples. No task ever holds more than one block of signal.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.config import FilterConfig
from statewave.functions.arrays import list_column, rows_of
from statewave.functions.iir import (
    BlockRunner, LinearFilter, bandpass_filter, notch_filter, odd_extension)
from statewave.operators.blocks import REC
from statewave.operators.scan import block_scan


def _padded(x: np.ndarray, pad: int, first: bool, last: bool) -> tuple[np.ndarray, int]:
    parts = [x]
    if first:
        parts.insert(0, odd_extension(x, pad, left=True))
    if last:
        parts.append(odd_extension(x, pad, left=False))
    return np.concatenate(parts), pad if first else 0


def _affine(matrix: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Row-vector form of ``z -> matrix z + offset`` with a constant 1 as last entry."""
    n = len(offset)
    out = np.zeros((n + 1, n + 1))
    out[:n, :n], out[n, :n], out[n, n] = matrix.T, offset, 1.0
    return out


def _answers(flt: LinearFilter):
    """Per block: forward map, backward map from rest, and how the forward entry state bends
    the backward map. All flattened for the scans."""
    order = flt.order

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        runner = BlockRunner(flt)
        eye = np.eye(order)
        shared: dict = {}
        for x_col, block_col, last_col in batches:
            fwd, back, bend = [], [], []
            for x, block, end in zip(rows_of(x_col), block_col.to_pylist(), last_col.to_pylist()):
                first, last = block == 0, block == end
                u, _ = _padded(x, flt.pad, first, last)
                start = flt.rest * u[0] if first else np.zeros(order)
                y, z = runner.run(u, start)
                zero = np.zeros(order) if not last else flt.rest * y[-1]
                _, zb = runner.run(y[::-1], zero)
                key = (len(u), last)
                if key not in shared:
                    # answer to each unit entry state: run the backward pass on its echo
                    columns = []
                    for e in eye:
                        echo, _ = runner.run(np.zeros(len(u)), e)
                        rest = flt.rest * echo[-1] if last else np.zeros(order)
                        columns.append(runner.run(echo[::-1], rest)[1])
                    shared[key] = np.stack(columns, axis=1)
                hop = runner.power(len(u))
                fwd.append(_affine(np.zeros((order, order)) if first else hop, z).ravel())
                back.append(np.concatenate([hop.ravel(), zb]))
                bend.append(shared[key].ravel())
            yield pa.StructArray.from_arrays(
                [list_column(fwd), list_column(back), list_column(bend)],
                names=["fwd", "back", "bend"])

    return F.arrow_udf(run, "struct<fwd:array<double>, back:array<double>, bend:array<double>>")


def _backward_maps(order: int):
    """Backward affine map of a block once its forward entry state is known."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for back, bend, carry, is_last in batches:
            out = []
            for h, m, z, last in zip(rows_of(back), rows_of(bend), rows_of(carry),
                                     is_last.to_pylist()):
                hop, zb = h[: order * order].reshape(order, order), h[order * order:]
                offset = zb + m.reshape(order, order) @ z[:order]
                out.append(_affine(np.zeros((order, order)) if last else hop, offset).ravel())
            yield list_column(out)

    return F.arrow_udf(run, "array<double>")


def _outputs(flt: LinearFilter):
    order = flt.order

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        runner = BlockRunner(flt)
        for x_col, block_col, last_col, zf_col, zb_col in batches:
            out = []
            for x, block, end, zf, zb in zip(rows_of(x_col), block_col.to_pylist(),
                                             last_col.to_pylist(), rows_of(zf_col),
                                             rows_of(zb_col)):
                first, last = block == 0, block == end
                u, skip = _padded(x, flt.pad, first, last)
                y, _ = runner.run(u, flt.rest * u[0] if first else zf[:order])
                back = flt.rest * y[-1] if last else zb[:order]
                smooth = runner.run(y[::-1], back)[0][::-1]
                out.append(smooth[skip: skip + len(x)])
            yield list_column(out)

    return F.arrow_udf(run, "array<double>")


def zero_phase(blocks: DataFrame, channel: str, flt: LinearFilter, max_blocks: int) -> DataFrame:
    """Forward-backward filter one array column of ``signal_blocks`` output.

    Both ends are extended by point reflection and both passes start in the steady state of
    their first sample.
    """
    order = flt.order
    dim = order + 1
    spot = blocks.select(
        REC, "block", "last_block", _answers(flt)(channel, "block", "last_block").alias("a")
    ).select(REC, "block", "last_block", "a.*")
    unit = F.array(*[F.lit(0.0)] * order, F.lit(1.0))
    forward = block_scan(
        spot.select(REC, "block", F.when(F.col("block") == 0, unit).alias("start"),
                    F.col("fwd").alias("m")),
        (), dim, "linear", max_blocks)
    is_last = F.col("block") == F.col("last_block")
    maps = spot.join(forward, [REC, "block"]).select(
        REC, "block", F.when(is_last, unit).alias("start"), "carry",
        _backward_maps(order)("back", "bend", "carry", is_last).alias("m"))
    backward = block_scan(maps, (), dim, "linear", max_blocks, reverse=True)
    states = forward.withColumnRenamed("carry", "zf").join(
        backward.withColumnRenamed("carry", "zb"), [REC, "block"])
    filtered = _outputs(flt)(channel, "block", "last_block", "zf", "zb").alias(channel)
    return blocks.join(states, [REC, "block"]).select(
        *[filtered if c == channel else F.col(c) for c in blocks.columns])


def _whole(stages: list[LinearFilter]):
    """All filters of a channel on recordings that are one block."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        runners = [(flt, BlockRunner(flt)) for flt in stages]
        for x_col in batches:
            out = []
            for x in rows_of(x_col):
                for flt, runner in runners:
                    u, skip = _padded(x, flt.pad, True, True)
                    y, _ = runner.run(u, flt.rest * u[0])
                    x = runner.run(y[::-1], flt.rest * y[-1])[0][::-1][skip: skip + len(x)]
                out.append(x)
            yield list_column(out)

    return F.arrow_udf(run, "array<double>")


def apply_filters(blocks: DataFrame, plan: dict[str, list[LinearFilter]], max_blocks: int,
                  materialise=lambda df: df) -> DataFrame:
    """Run each channel's filters in turn, forwards and backwards.

    Recordings of one block are filtered in place. For longer ones every stage is
    materialised once, because the scan and the second pass both read it.
    """
    short = blocks.filter("last_block = 0").select(*[
        _whole(plan[c])(c).alias(c) if plan.get(c) else F.col(c) for c in blocks.columns])
    if max_blocks <= 1:
        return materialise(short)
    long = blocks.filter("last_block > 0")
    for channel, stages in plan.items():
        for flt in stages:
            long = materialise(zero_phase(long, channel, flt, max_blocks))
    return materialise(short).unionByName(long)


def filter_blocks(blocks: DataFrame, fs: float, max_blocks: int, has_emg: bool,
                  config: FilterConfig | None = None, materialise=lambda df: df) -> DataFrame:
    """Band-pass, then notch, on every channel of ``signal_blocks`` output."""
    cfg = config or FilterConfig()
    channels = [("eeg", cfg.eeg_band)] + ([("emg", cfg.emg_band)] if has_emg else [])
    notch = notch_filter(cfg.notch_freq, cfg.notch_quality, fs)
    plan = {c: [f for f in (bandpass_filter(cfg.filter_order, *band, fs), notch) if f is not None]
            for c, band in channels}
    return apply_filters(blocks, plan, max_blocks, materialise)


def unpack_blocks(blocks: DataFrame) -> DataFrame:
    """Block arrays back to ``recording_id, sample_idx, eeg, emg`` rows."""
    pairs = F.arrays_zip(F.col("eeg").alias("eeg"), F.col("emg").alias("emg"))
    return blocks.select(REC, "start_idx", F.posexplode(pairs).alias("at", "v")).select(
        REC, (F.col("start_idx") + F.col("at")).alias("sample_idx"),
        F.col("v.eeg").alias("eeg"), F.col("v.emg").alias("emg"))
