"""Z-score and min-max scaling of signals and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewave.operators.blocks import REC
from statewave.session import maybe_broadcast


def zscore_signal(samples: DataFrame, channels: list[str], n_recordings: int) -> DataFrame:
    """Population z-score per recording and channel; a flat channel is only centred."""
    stats = samples.groupBy(REC).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in channels],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in channels],
    )
    joined = samples.join(maybe_broadcast(stats, n_recordings, 32 + 16 * len(channels)), REC)
    for c in channels:
        centred = F.col(c) - F.col(f"_m_{c}")
        joined = joined.withColumn(
            c, F.when(F.col(f"_s_{c}") < 1e-8, centred).otherwise(centred / F.col(f"_s_{c}")))
    return joined.select(*samples.columns)


def _standardised(array: str, mean: Column, spread: Column) -> Column:
    return F.transform(array, lambda v: (v - mean) / spread)


def zscore_blocks(blocks: DataFrame, channels: list[str], n_recordings: int) -> DataFrame:
    """The same on signal blocks; statistics are combined per value, arrays stay arrays."""
    stats = None
    for c in channels:
        cell = blocks.select(REC, F.explode(c).alias("v")).groupBy(REC).agg(
            F.avg("v").alias(f"_m_{c}"), F.stddev_pop("v").alias(f"_s_{c}"))
        stats = cell if stats is None else stats.join(cell, REC)
    joined = blocks.join(maybe_broadcast(stats, n_recordings, 32 + 16 * len(channels)), REC)
    for c in channels:
        mean = F.col(f"_m_{c}")
        spread = F.when(F.col(f"_s_{c}") < 1e-8, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        joined = joined.withColumn(c, _standardised(c, mean, spread))
    return joined.select(*blocks.columns)


def _unless_flat(width: Column) -> Column:
    return F.when(width < 1e-8, F.lit(1.0)).otherwise(width)


def fit_scaler(table: DataFrame, columns: list[str], method: str = "zscore") -> DataFrame:
    """One row per recording: ``center_<c>`` and ``scale_<c>`` for every column."""
    if method == "minmax":
        aggregates = [F.min(c).alias(f"center_{c}") for c in columns]
        aggregates += [_unless_flat(F.max(c) - F.min(c)).alias(f"scale_{c}") for c in columns]
    elif method == "zscore":
        aggregates = [F.avg(c).alias(f"center_{c}") for c in columns]
        aggregates += [_unless_flat(F.stddev_pop(c)).alias(f"scale_{c}") for c in columns]
    else:
        raise ValueError(f"Unknown scaling method: {method}")
    return table.groupBy(REC).agg(*aggregates)


def apply_scaler(table: DataFrame, scaler: DataFrame, columns: list[str],
                 n_recordings: int) -> DataFrame:
    joined = table.join(maybe_broadcast(scaler, n_recordings, 32 + 16 * len(columns)), REC)
    scaled = [((F.col(c) - F.col(f"center_{c}")) / F.col(f"scale_{c}")).alias(c)
              if c in columns else F.col(c) for c in table.columns]
    return joined.select(*scaled)


def inverse_scale(value: Column, center: Column, scale: Column) -> Column:
    return value * scale + center


# The columns shown first when a figure has room for a few features only.
FEATURE_PRIORITY = [
    "eeg_energy",
    "emg_energy",
    "eeg_peak_to_peak",
    "emg_peak_to_peak",
    "eeg_zcr",
    "emg_zcr",
    "eeg_peak_count",
    "emg_peak_count",
    "eeg_dominant_frequency",
    "eeg_spectral_entropy",
]


def feature_subset(columns: list[str], limit: int) -> list[str]:
    """Columns to show: known ones first, then the rest, at most ``limit``."""
    if len(columns) <= limit:
        return list(columns)
    rank = {name: i for i, name in enumerate(FEATURE_PRIORITY)}
    return sorted(columns, key=lambda c: rank.get(c, len(rank) + columns.index(c)))[:limit]
