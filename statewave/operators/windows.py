"""Fixed-length overlapping windows over regularly sampled recordings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.operators.blocks import REC


@dataclass(frozen=True)
class WindowPlan:
    """Window length and hop in samples."""

    size: int
    step: int

    def count(self, n_samples: int) -> int:
        return 0 if n_samples < self.size else (n_samples - self.size) // self.step + 1


def plan_windows(window_sec: float, overlap_sec: float, fs: float) -> WindowPlan:
    """Convert seconds to samples; Python's round (half to even) is part of the contract."""
    size = int(round(window_sec * fs))
    step = size - int(round(overlap_sec * fs))
    if size <= 0 or step <= 0:
        raise ValueError("Window length must be positive and overlap must be smaller than the window size.")
    return WindowPlan(size, step)


def auto_window(n_samples: int, fs: float) -> tuple[int, int]:
    """Window and overlap in samples of the ``notebook_auto`` strategy."""
    size = min(int(n_samples / 20), int(fs * 0.1))
    return size, int(size * 0.25)


def require_full_window(lengths: DataFrame, plan: WindowPlan) -> None:
    shortest = lengths.agg(F.min("n_rows")).first()[0]
    if shortest is None or shortest < plan.size:
        raise ValueError("Signal is shorter than the requested window size.")


def assign_windows(samples: DataFrame, plan: WindowPlan) -> DataFrame:
    """One row per (window, sample); a sample lands in at most ceil(size/step) windows.

    Trailing windows may still be incomplete here; they are dropped by row count after the
    grouping that every consumer does anyway, so no length table has to be joined.
    """
    size, step = plan.size, plan.step
    if size == step:
        return samples.withColumn("window_index", F.expr(f"sample_idx div {step}"))
    first = F.when(F.col("sample_idx") < size, F.lit(0)).otherwise(
        F.expr(f"(sample_idx - {size}) div {step} + 1")).cast("bigint")
    last = F.expr(f"sample_idx div {step}").cast("bigint")
    # sequence(3, 2) would count down, so samples in a gap between windows go first
    return (
        samples.withColumn("_first", first).withColumn("_last", last)
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn("window_index", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )


def window_arrays(samples: DataFrame, plan: WindowPlan) -> DataFrame:
    """Complete windows as arrays: ``recording_id, window_index, eeg, emg``."""
    return (
        assign_windows(samples, plan)
        .groupBy(REC, "window_index")
        .agg(F.sort_array(F.collect_list(F.struct("sample_idx", "eeg", "emg"))).alias("rows"))
        .filter(F.size("rows") == plan.size)
        .select(REC, "window_index", F.col("rows.eeg").alias("eeg"), F.col("rows.emg").alias("emg"))
    )


def window_arrays_from_blocks(blocks: DataFrame, plan: WindowPlan) -> DataFrame:
    """Same result from block arrays: windows are cut as slices, samples are never exploded.

    A window inside one block is emitted where it lies. Only windows that straddle blocks
    are put together by a shuffle, which then carries slices instead of samples. ``blocks``
    is read twice and should be materialised.
    """
    size, step = plan.size, plan.step
    first = F.when(F.col("start_idx") < size, F.lit(0)).otherwise(
        F.expr(f"(start_idx - {size}) div {step} + 1")).cast("bigint")
    last = F.expr(f"(start_idx + size(eeg) - 1) div {step}").cast("bigint")
    cut = (
        blocks.withColumn("_first", first).withColumn("_last", last)
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn("window_index", F.explode(F.sequence("_first", "_last")))
        .withColumn("_from", F.greatest(F.col("window_index") * step, F.col("start_idx")))
        .withColumn("_to", F.least(F.col("window_index") * step + size,
                                   F.col("start_idx") + F.size("eeg")))
        .withColumn("_at", (F.col("_from") - F.col("start_idx") + 1).cast("int"))
        .withColumn("_len", (F.col("_to") - F.col("_from")).cast("int"))
        .filter(F.col("_len") > 0)
    )
    slices = [F.slice(c, F.col("_at"), F.col("_len")).alias(c) for c in ("eeg", "emg")]
    whole = cut.filter(F.col("_len") == size).select(REC, "window_index", *slices)
    pieces = (
        cut.filter(F.col("_len") < size)
        .select(REC, "window_index", F.struct(F.col("_from").alias("at"), *slices).alias("piece"))
        .groupBy(REC, "window_index")
        .agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
        .select(REC, "window_index", F.flatten("pieces.eeg").alias("eeg"),
                F.flatten("pieces.emg").alias("emg"))
        .filter(F.size("eeg") == size)
    )
    return whole.unionByName(pieces)


def window_times(index: DataFrame, plan: WindowPlan, fs: float, window_sec: float) -> DataFrame:
    """``window_index, start_time_sec, end_time_sec`` next to the recording id."""
    start = F.col("window_index") * F.lit(plan.step) / F.lit(float(fs))
    return index.select(REC, "window_index", start.alias("start_time_sec"),
                        (start + F.lit(float(window_sec))).alias("end_time_sec"))
