"""Pipeline stages from signals to labelled windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.config import ClusterConfig, FilterConfig, WindowConfig
from statewave.operators import blocks as B
from statewave.operators import gmm as G
from statewave.operators import hierarchical as H
from statewave.operators import kmeans as K
from statewave.operators import metrics
from statewave.operators.features import Features
from statewave.operators.filters import filter_blocks
from statewave.operators.scaling import zscore_blocks
from statewave.operators.windows import (
    WindowPlan, plan_windows, require_full_window, window_arrays_from_blocks)
from statewave.session import cut_lineage
from statewave.sources.files import Signal

REC = B.REC
METHODS = ["kmeans", "gmm", "hierarchical"]


@dataclass
class Preprocessed:
    """Raw and filtered signal in block form, with the lengths of the recordings."""

    raw: DataFrame
    filtered: DataFrame
    lengths: DataFrame
    fs: float
    has_emg: bool
    n_recordings: int
    longest: int


def preprocess(signal: Signal, config: FilterConfig | None = None) -> Preprocessed:
    """Band-pass, notch and z-score every recording; the raw signal is kept."""
    cfg = config or FilterConfig()
    lengths = cut_lineage(B.recording_lengths(signal.samples))
    n, longest, shortest = lengths.agg(
        F.count(F.lit(1)), F.max("n_rows"), F.min("n_rows")).first()
    if not n:
        raise ValueError("The input holds no samples.")
    pad = 3 * (2 * cfg.filter_order + 1)
    if shortest <= pad:
        raise ValueError(f"Recordings need more than {pad} samples to be filtered.")
    raw = cut_lineage(B.signal_blocks(signal.samples, lengths, n))
    filtered = filter_blocks(raw, signal.fs, max(longest // B.SIGNAL_BLOCK, 1), signal.has_emg, cfg,
                             cut_lineage)
    if cfg.standardize_signal:
        channels = ["eeg", "emg"] if signal.has_emg else ["eeg"]
        filtered = cut_lineage(zscore_blocks(filtered, channels, n))
    return Preprocessed(raw, filtered, lengths, signal.fs, signal.has_emg, n, longest)


@dataclass
class Windows:
    arrays: DataFrame  # recording_id, window_index, eeg, emg
    plan: WindowPlan
    window_sec: float
    overlap_sec: float


def window_signals(data: Preprocessed, config: WindowConfig | None = None) -> Windows:
    """Complete windows of the filtered signal; the incomplete tail is dropped."""
    cfg = config or WindowConfig()
    plan = plan_windows(cfg.window_sec, cfg.overlap_sec, data.fs)
    require_full_window(data.lengths, plan)
    return Windows(window_arrays_from_blocks(data.filtered, plan), plan, cfg.window_sec,
                   cfg.overlap_sec)


@dataclass
class Clustering:
    labels: DataFrame  # recording_id, window_index, method, label
    metrics: DataFrame  # recording_id, method, silhouette, davies_bouldin, balance_entropy, bic, aic
    average_spectra: DataFrame  # recording_id, method, label, bin, power
    kmeans: DataFrame
    gmm: DataFrame


def cluster(features: Features, blocks: B.Blocks, config: ClusterConfig | None = None) -> Clustering:
    """K-means, Gaussian mixture and hierarchical labels with their quality measures."""
    cfg = config or ClusterConfig()
    km = K.kmeans(blocks, cfg)
    mix = G.gmm(blocks, km.model.select(REC, "centroids"), cfg)
    tree = H.hierarchical(blocks, cfg)
    labels = None
    for name, part in zip(METHODS, (km.labels, mix.labels, tree)):
        part = part.select(REC, "window_index", F.lit(name).alias("method"), "label")
        labels = part if labels is None else labels.unionByName(part)
    labels = cut_lineage(labels)
    table = (
        metrics.silhouette(features.scaled, features.names, labels, blocks.lengths,
                           cfg.metric_sample_size, cfg.random_seed)
        .join(metrics.davies_bouldin(features.scaled, features.names, labels), [REC, "method"])
        .join(metrics.balance_entropy(labels), [REC, "method"])
        .join(mix.model.select(REC, F.lit("gmm").alias("method"), "bic", "aic"), [REC, "method"],
              "left"))
    return Clustering(labels, cut_lineage(table),
                      metrics.average_spectra(features.spectra, labels, cfg.n_clusters),
                      km.model, mix.model)
