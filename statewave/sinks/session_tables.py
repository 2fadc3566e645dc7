"""What report, figures and page of every recording are drawn from, as one row set.

All parts are Spark aggregates keyed by recording. Their rows per recording are bounded by what a
drawing can show: columns and cells of its plot area, bins, states, the opening seconds. The
windows themselves, with labels, spectra and coordinates, go to ``epoch_files`` instead.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.operators.blocks import REC
from statewave.operators.filters import unpack_blocks
from statewave.operators.scaling import feature_subset
from statewave.operators.summary import (
    box_stats, histogram, minmax_pyramid, pyramid_blocks, quantise_column, threshold_summary, unpivot)
from statewave.session import maybe_broadcast

TRACE_SEC = 20.0  # length of the raw/filtered trace
BOUNDARY_SEC = 60.0  # least length of the window figure
#: One column for each pixel of the widest plot area; cells of a scatter, about a dot apart.
COLUMNS, GRID = 810, (240, 200)
SPECTRUM_ROWS = 60


def opening(blocks: DataFrame, seconds: float, fs: float) -> DataFrame:
    """Channels of the first seconds as arrays."""
    head = unpack_blocks(blocks.filter(F.col("start_idx") < int(seconds * fs) + 1)).filter(F.col("sample_idx") < seconds * fs)
    rows = F.sort_array(F.collect_list(F.struct("sample_idx", "eeg", "emg"))).alias("s")
    return head.groupBy(REC).agg(rows).select(REC, F.col("s.sample_idx").alias("at"), F.col("s.eeg").alias("eeg"), F.col("s.emg").alias("emg"))


def aligned_spectra(result) -> DataFrame:
    """Mean spectra under the labels that figures and page show."""
    return result.clustering.average_spectra.join(result.alignment.mapping, [REC, "method", "label"], "left").select(
        REC, "method", F.coalesce("aligned_label", "label").alias("label"), "bin", "power")


def most_frequent(states: DataFrame) -> DataFrame:
    """``series, column, state`` from (series, column, state) of every window; ties to the smaller state."""
    counts = states.groupBy(REC, "series", "column", "state").count()
    return counts.groupBy(REC, "series", "column").agg(F.max_by("state", F.struct("count", -F.col("state"))).alias("state"))


def scatter(result, labels: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occupied cells of the plane with their most frequent states, its extent, and the windows' cells."""
    points = result.manifold.embedding
    y = F.col("dim_2") if "dim_2" in points.columns else F.lit(0.0)
    points = points.select(REC, "window_index", F.col("dim_1").alias("x"), y.alias("y"))
    extent = points.groupBy(REC).agg(*[f(c).alias(f"{c}_{name}") for c in "xy" for name, f in (("low", F.min), ("high", F.max))])
    place = lambda c, cells: F.least(F.lit(cells - 1), F.floor(
        (F.col(c) - F.col(f"{c}_low")) / F.greatest(F.col(f"{c}_high") - F.col(f"{c}_low"), F.lit(1e-300)) * cells)).cast("int")
    placed = points.join(maybe_broadcast(extent, n, 96), REC).select(
        REC, "window_index", "x", "y", place("x", GRID[0]).alias("cx"), place("y", GRID[1]).alias("cy"))
    counts = placed.join(labels, [REC, "window_index"]).groupBy(REC, "method", "cx", "cy", "aligned_label").agg(
        F.count("*").alias("n"), F.min("window_index").alias("first"))
    cells = counts.groupBy(REC, "method", "cx", "cy").agg(
        F.max_by("aligned_label", F.struct("n", -F.col("aligned_label"))).alias("state"), F.sum("n").alias("n"), F.min("first").alias("first"))
    return cells, extent, placed


def levels(result) -> tuple[DataFrame, DataFrame]:
    """Pyramid levels of the channels as arrays of 16-bit codes, and the channels' ranges."""
    data = result.preprocess
    samples = unpack_blocks(data.raw)
    sizes, parts, ranges = pyramid_blocks(data.longest), [], []
    for channel in ["eeg", "emg"] if data.has_emg else ["eeg"]:
        pyramid = minmax_pyramid(samples, channel, sizes)
        codes = quantise_column(pyramid, ["low", "high"], channel, samples, data.n_recordings)
        rows = F.sort_array(F.collect_list(F.struct("bin", "low", "high"))).alias("b")
        parts.append(codes.groupBy(REC, "block_size").agg(rows).select(
            REC, F.lit(channel).alias("channel"), "block_size", F.col("b.low").alias("low"), F.col("b.high").alias("high")))
        ranges.append(samples.groupBy(REC).agg(F.min(channel).alias("low"), F.max(channel).alias("high")).select(
            REC, F.lit(channel).alias("channel"), "low", "high"))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, ranges)


def session_tables(result) -> dict[str, DataFrame]:
    data, f, n = result.preprocess, result.features, result.preprocess.n_recordings
    windows = f.raw.groupBy(REC).agg(F.count("*").alias("n_windows"))
    strides = maybe_broadcast(windows.select(REC, F.ceil(F.col("n_windows") / COLUMNS).alias("stride")), n, 64)
    in_columns = lambda df: df.join(strides, REC).withColumn("column", F.expr("window_index div stride"))
    labels = result.alignment.labels.select(REC, "window_index", "method", "aligned_label")
    series = labels.select(REC, "window_index", F.col("method").alias("series"), F.col("aligned_label").alias("state")).unionByName(
        result.hmm.states.select(REC, "window_index", F.concat(F.lit("hmm"), "n_states").alias("series"), F.col("hidden_state").alias("state")))
    features = unpivot(f.raw, f.names, [REC])
    names = feature_subset(f.names, 4)
    values = unpivot(f.raw.join(labels, [REC, "window_index"]), names, [REC, "method", "aligned_label"])
    cells, extent, placed = scatter(result, labels, n)
    bins = -(-len(f.freqs) // SPECTRUM_ROWS)
    pyramid, ranges = levels(result)
    ends = lambda df, keys, value: df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    longest = windows.agg(F.max("n_windows")).first()[0] or 0
    x = result.explain
    tables = {
        "size": data.lengths.join(windows, REC),
        "raw": opening(data.raw, TRACE_SEC, data.fs), "clean": opening(data.filtered, TRACE_SEC, data.fs),
        "boundary": opening(data.filtered, max(BOUNDARY_SEC, 3 * result.windows.window_sec), data.fs),
        "first": f.spectra.filter("window_index = 0").select(REC, "power"),
        "grid": in_columns(f.spectra.select(REC, "window_index", F.posexplode("power").alias("bin", "p"))).groupBy(
            REC, "column", F.expr(f"bin div {bins}").alias("row")).agg(F.avg("p").alias("p")),
        "histograms": histogram(features, [REC, "feature"], "value", 30), "ranges": ends(features, [REC, "feature"], "value"),
        "timeline": most_frequent(in_columns(series)), "stride": windows.select(REC, F.ceil(F.col("n_windows") / COLUMNS).alias("stride")),
        "boxes": box_stats(values, [REC, "feature", "method", "aligned_label"], "value", longest),
        "spectra": aligned_spectra(result),
        "metrics": result.clustering.metrics.join(x.fidelity, [REC, "method"]).withColumnRenamed("fidelity", "explain_fidelity"),
        "before": result.alignment.before, "after": result.alignment.after, "nodes": x.nodes, "importance": x.importance,
        "thresholds": x.thresholds, "threshold_summary": threshold_summary(x.thresholds, [REC, "method"]), "rules": x.rules,
        "models": result.hmm.models, "runs": histogram(result.hmm.runs, [REC, "n_states", "state"], "duration_sec", 20),
        "run_ranges": ends(result.hmm.runs, [REC, "n_states", "state"], "duration_sec"),
        "cells": cells, "extent": extent,
        "path": in_columns(placed).groupBy(REC, "column").agg(F.avg("x").alias("x"), F.avg("y").alias("y")),
        "levels": pyramid, "channels": ranges,
    }
    if result.manifold.eigenvalues is not None:
        tables["eigenvalues"] = result.manifold.eigenvalues
    return tables


def as_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """All parts in one table ``recording_id, part, row``, rows as JSON."""
    parts = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != REC]
        row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        parts.append(df.select(REC, F.lit(name).alias("part"), row.alias("row")))
    return reduce(DataFrame.union, parts)


def frames_of(pdf: pd.DataFrame) -> dict[str, pd.DataFrame]:
    """One recording's parts from its rows."""
    odd = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
    frames = {}
    for name, rows in pdf.groupby("part")["row"]:
        values = [json.loads(r) for r in rows]
        frames[name] = pd.DataFrame([{k: odd.get(v, v) if isinstance(v, str) else v for k, v in r.items()} for r in values])
    return frames
