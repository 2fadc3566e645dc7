"""Time-domain window features as plain column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statewave.operators.blocks import REC
from statewave.operators.windows import WindowPlan, assign_windows


def sign_bit(x: Column) -> Column:
    """True for negative numbers and for -0.0; only zeros pay for the text check."""
    return (x < 0) | ((x == 0) & (x.cast("string") == F.lit("-0.0")))


def time_features(samples: DataFrame, plan: WindowPlan, fs: float, channel: str = "eeg",
                  peak_height_std: float = 0.75) -> DataFrame:
    """Energy, range, zero crossings, peaks and normalised square integral per window.

    One shuffle on (recording, window) and one sort feed every lag, lead and the spread.
    """
    x = F.col(channel)
    order = W.partitionBy(REC, "window_index").orderBy("sample_idx")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = assign_windows(samples.select(REC, "sample_idx", channel), plan).select(
        REC, "window_index", x,
        F.lag(channel).over(order).alias("before"),
        F.lead(channel).over(order).alias("after"),
        F.stddev_pop(channel).over(whole).alias("spread"),
    )
    before, after = F.col("before"), F.col("after")
    area = (x * x + before * before) / 2
    floor = F.greatest(F.col("spread") * F.lit(float(peak_height_std)), F.lit(1e-8))
    peak = (F.abs(x) > F.abs(before)) & (F.abs(x) >= F.abs(after)) & (F.abs(x) >= floor)
    crossing = before.isNotNull() & (sign_bit(x) != sign_bit(before))
    return (
        near.groupBy(REC, "window_index")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            (F.coalesce(F.sum(area), F.lit(0.0)) * F.lit(1.0 / fs)).alias(f"{channel}_energy"),
            (F.max(x) - F.min(x)).alias(f"{channel}_peak_to_peak"),
            (F.sum(F.when(crossing, 1.0).otherwise(0.0)) / float(max(plan.size - 1, 1)))
            .alias(f"{channel}_zcr"),
            F.sum(F.when(peak, 1.0).otherwise(0.0)).alias(f"{channel}_peak_count"),
            (F.coalesce(F.sum(area), F.lit(0.0)) / float(max(plan.size, 1)))
            .alias(f"{channel}_iemg2"),
        )
        .filter(F.col("_n") == plan.size)
        .drop("_n")
    )
