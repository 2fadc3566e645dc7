"""Synthetic EEG and EMG with three states, for demonstrations and tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from statewave.sources.files import Signal

# Fixed values per third of the recording: EEG rhythm in Hz, its amplitude, EEG noise, EMG noise.
STAGES = [(2.0, 1.2, 0.15, 0.15), (6.0, 0.9, 0.2, 0.35), (12.0, 0.6, 0.35, 0.8)]


def synthetic_arrays(fs: float, duration_sec: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same arrays for the same seed: EEG noise is drawn stage by stage, then EMG noise."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(fs * duration_sec)) / fs
    edges = [0, t.size // 3, 2 * (t.size // 3), t.size]
    spans = list(zip(edges[:-1], edges[1:], STAGES))
    eeg = np.concatenate([
        amplitude * np.sin(2 * np.pi * hz * t[a:b]) + noise * rng.standard_normal(b - a)
        for a, b, (hz, amplitude, noise, _) in spans])
    emg = np.concatenate([noise * rng.standard_normal(b - a) for a, b, (_, _, _, noise) in spans])
    return eeg, emg


def signal_from_arrays(spark: SparkSession, eeg, fs: float, emg=None,
                       recording_id: str = "recording") -> Signal:
    """Arrays that already are in memory as a signal."""
    eeg = np.asarray(eeg, dtype=float).squeeze()
    if eeg.ndim != 1:
        raise ValueError("EEG must be a one-dimensional array.")
    emg = None if emg is None else np.asarray(emg, dtype=float).squeeze()
    if emg is not None and emg.shape != eeg.shape:
        raise ValueError("EEG and EMG must have the same length when both are provided.")
    frame = pd.DataFrame({"recording_id": recording_id, "sample_idx": np.arange(eeg.size),
                          "eeg": eeg, "emg": np.nan if emg is None else emg})
    samples = spark.createDataFrame(
        frame, "recording_id string, sample_idx bigint, eeg double, emg double")
    if emg is None:
        samples = samples.withColumn("emg", F.lit(None).cast("double"))
    return Signal(samples, float(fs), emg is not None)


def synthetic_demo(spark: SparkSession, fs: float = 128.0, duration_sec: float = 1800.0,
                   seed: int = 42) -> Signal:
    eeg, emg = synthetic_arrays(fs, duration_sec, seed)
    return signal_from_arrays(spark, eeg, fs, emg, "demo")
