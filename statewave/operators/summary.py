"""Aggregations behind the report and the session view."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewave.operators.blocks import REC
from statewave.operators.quantiles import BUFFER_ROWS, exact_quantiles, value_counts
from statewave.session import maybe_broadcast

# Signal pyramid of the session view.
PYRAMID_BINS = 180_000
PYRAMID_LEVELS = 4
PYRAMID_FACTOR = 4


def pyramid_blocks(n_samples: int, max_bins: int = PYRAMID_BINS) -> list[int]:
    """Samples per bin of every pyramid level, finest first."""
    size, out = max(1, math.ceil(n_samples / max_bins)), []
    while len(out) < PYRAMID_LEVELS:
        out.append(size)
        if size >= n_samples:
            break
        size *= PYRAMID_FACTOR
    return out


def minmax_pyramid(samples: DataFrame, channel: str, blocks: list[int]) -> DataFrame:
    """``recording_id, block_size, bin, low, high``; coarser levels come from finer ones."""
    level = samples.groupBy(REC, F.expr(f"sample_idx div {blocks[0]}").alias("bin")).agg(
        F.min(channel).alias("low"), F.max(channel).alias("high"))
    out = level.select(REC, F.lit(blocks[0]).cast("bigint").alias("block_size"), "bin", "low", "high")
    for finer, size in zip(blocks, blocks[1:]):
        level = level.groupBy(REC, F.expr(f"bin div {size // finer}").alias("bin")).agg(
            F.min("low").alias("low"), F.max("high").alias("high"))
        out = out.unionByName(level.select(
            REC, F.lit(size).cast("bigint").alias("block_size"), "bin", "low", "high"))
    return out


def quantise(value: Column, low: Column, high: Column) -> Column:
    """16-bit code of a value within [low, high], rounding half to even."""
    code = F.bround((value - low) / F.greatest(high - low, F.lit(1e-300)) * 65535.0 - 32768.0, 0)
    return F.when(high - low <= 1e-12, F.lit(0)).otherwise(
        F.least(F.greatest(code, F.lit(-32768.0)), F.lit(32767.0)).cast("int"))


def quantise_column(df: DataFrame, columns: list[str], reference: str, source: DataFrame,
                    n_recordings: int) -> DataFrame:
    """Codes of ``columns`` on the value range of ``source.reference`` per recording."""
    bounds = source.groupBy(REC).agg(F.min(reference).alias("_lo"), F.max(reference).alias("_hi"))
    joined = df.join(maybe_broadcast(bounds, n_recordings, 64), REC)
    return joined.select(*[quantise(F.col(c), F.col("_lo"), F.col("_hi")).alias(c)
                           if c in columns else F.col(c) for c in df.columns])


def unpivot(table: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per key and feature: ``keys, feature, value``."""
    return table.unpivot(keys, columns, "feature", "value")


def histogram(cells: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width bin counts per group; the last bin is closed. A constant group is binned
    in a unit interval around its value."""
    bounds = cells.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    bounds = bounds.select(*keys, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                           F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    place = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * float(bins))
    return (
        cells.join(bounds, keys)
        .groupBy(*keys, F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_stats(cells: DataFrame, keys: list[str], value: str, max_rows: int) -> DataFrame:
    """Quartiles and extremes per group; ``max_rows`` is the counted size of the largest."""
    probs = [0.25, 0.5, 0.75]
    if max_rows <= BUFFER_ROWS:
        stats = cells.groupBy(*keys).agg(
            F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("q"),
            F.min(value).alias("low"), F.max(value).alias("high"))
    else:
        edges = cells.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
        stats = exact_quantiles(value_counts(cells, keys, value), keys, probs).join(edges, keys)
    return stats.select(*keys, "low", *[F.col("q")[i].alias(n)
                                        for i, n in enumerate(("q1", "median", "q3"))], "high")


def threshold_summary(thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute raw threshold per feature."""
    return thresholds.groupBy(*keys, "feature").agg(
        F.avg(F.abs("threshold_raw")).alias("mean_abs_threshold"))


def threshold_pivot(thresholds: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Clusters as rows, raw thresholds of ``features`` as columns."""
    return thresholds.groupBy(*keys, "cluster").pivot("feature", features).agg(
        F.first("threshold_raw"))


def transition_edges(matrix: DataFrame, least: float = 0.05) -> DataFrame:
    """Transitions worth drawing."""
    return matrix.filter(F.col("probability") >= least)


def every_nth(df: DataFrame, index: str, stride: int) -> DataFrame:
    return df.filter(F.col(index) % stride == 0)
