"""Window features: spectra from an Arrow kernel, the table laid out by configuration."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.config import FeatureConfig
from statewave.functions.arrays import matrix_column, matrix_of
from statewave.operators.blocks import REC
from statewave.operators.scaling import apply_scaler, fit_scaler
from statewave.operators.windows import WindowPlan

SHAPE_STATS = ["energy", "peak_to_peak", "zcr", "peak_count"]


def spectrum_grid(size: int, fs: float, max_hz: float) -> np.ndarray:
    """Frequencies kept from the one-sided transform of a window, in Hz."""
    grid = np.fft.rfftfreq(size, d=1.0 / fs)
    return grid[grid <= max_hz]


def feature_names(config: FeatureConfig, has_emg: bool) -> list[str]:
    """Column order of the feature table; split ties depend on it."""
    if config.mode == "legacy":
        return ["peak_to_peak", "zero_crossing_rate", "peak_count", "iemg2"]
    names = [f"eeg_{s}" for s in SHAPE_STATS]
    names += ["eeg_dominant_frequency", "eeg_spectral_entropy", "eeg_total_power"]
    for band in config.band_definitions:
        names += [f"eeg_{band}_power", f"eeg_{band}_ratio"]
    if has_emg:
        names += [f"emg_{s}" for s in SHAPE_STATS]
    return names


def _trapezoid(y: np.ndarray, dx: float) -> np.ndarray:
    if y.shape[1] < 2:
        return np.zeros(len(y))
    return (y.sum(axis=1) - 0.5 * (y[:, 0] + y[:, -1])) * dx


def _shape_stats(x: np.ndarray, fs: float, height: float) -> dict[str, np.ndarray]:
    mag, sign = np.abs(x), np.signbit(x)
    floor = np.maximum(x.std(axis=1) * height, 1e-8)[:, None]
    mid = mag[:, 1:-1]
    peaks = (mid > mag[:, :-2]) & (mid >= mag[:, 2:]) & (mid >= floor)
    area = _trapezoid(x * x, 1.0)
    width = x.shape[1]
    return {
        "energy": area / fs,
        "peak_to_peak": x.max(axis=1) - x.min(axis=1),
        "zcr": (sign[:, 1:] != sign[:, :-1]).sum(axis=1) / max(width - 1, 1),
        "peak_count": peaks.sum(axis=1).astype(float),
        "iemg2": area / max(width, 1),
    }


def _spectral_stats(power: np.ndarray, grid: np.ndarray, bands: dict) -> dict[str, np.ndarray]:
    df = grid[1] - grid[0] if grid.size > 1 else 1.0
    total = _trapezoid(power, df)
    share = power / np.maximum(total, 1e-12)[:, None]
    bits = np.log2(np.where(share > 0, share, 1.0))
    out = {
        "dominant_frequency": grid[power.argmax(axis=1)],
        "spectral_entropy": -(share * bits).sum(axis=1),
        "total_power": total,
    }
    for band, (low, high) in bands.items():
        inside = power[:, (grid >= low) & (grid < high)]
        out[f"{band}_power"] = _trapezoid(inside, df)
        out[f"{band}_ratio"] = out[f"{band}_power"] / np.maximum(total, 1e-12)
    return out


def power_spectrum(x: np.ndarray, kept: int) -> np.ndarray:
    """Hann-tapered power of every row, scaled by the taper's energy, first ``kept`` bins."""
    taper = np.hanning(x.shape[1])
    return np.abs(np.fft.rfft(x * taper, axis=1)[:, :kept]) ** 2 / max((taper**2).sum(), 1e-12)


def feature_table(windows: DataFrame, plan: WindowPlan, fs: float, config: FeatureConfig,
                  has_emg: bool) -> DataFrame:
    """``recording_id, window_index``, one column per feature, and ``power`` (the spectrum)."""
    names = feature_names(config, has_emg)
    grid = spectrum_grid(plan.size, fs, config.max_spectrum_hz)
    bands, height, size = dict(config.band_definitions), config.peak_height_std, plan.size
    legacy = config.mode == "legacy"

    def kernel(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            eeg_col, emg_col = batch if has_emg else (batch, None)
            eeg = matrix_of(eeg_col, size)
            power = power_spectrum(eeg, grid.size)
            cells = {f"eeg_{k}": v for k, v in _shape_stats(eeg, fs, height).items()}
            cells |= {f"eeg_{k}": v for k, v in _spectral_stats(power, grid, bands).items()}
            if has_emg:
                emg = matrix_of(emg_col, size)
                cells |= {f"emg_{k}": v for k, v in _shape_stats(emg, fs, height).items()}
            if legacy:
                main = "emg" if has_emg else "eeg"
                source = dict(zip(names, ("peak_to_peak", "zcr", "peak_count", "iemg2")))
                cells = {n: cells[f"{main}_{s}"] for n, s in source.items()}
            yield pa.StructArray.from_arrays(
                [pa.array(np.asarray(cells[n], dtype=float)) for n in names] + [matrix_column(power)],
                names=names + ["power"])

    schema = ", ".join(f"`{n}` double" for n in names) + ", power array<double>"
    if has_emg:
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            yield from kernel(batches)
        args = ["eeg", "emg"]
    else:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from kernel(batches)
        args = ["eeg"]
    udf = F.arrow_udf(run, f"struct<{schema.replace(' ', ':').replace(',:', ', ')}>")
    return windows.select(REC, "window_index", udf(*args).alias("f")).select(
        REC, "window_index", "f.*")


@dataclass
class Features:
    """Feature tables of a run. All frames are keyed by ``recording_id, window_index``."""

    raw: DataFrame
    scaled: DataFrame
    scaler: DataFrame
    names: list[str]
    freqs: np.ndarray
    spectra: DataFrame
    plan: WindowPlan


def extract_features(windows: DataFrame, plan: WindowPlan, fs: float, n_recordings: int,
                     config: FeatureConfig | None = None, has_emg: bool = True,
                     materialise=None) -> Features:
    """Raw and scaled feature tables; ``materialise`` is applied once to the kernel output."""
    cfg = config or FeatureConfig()
    names = feature_names(cfg, has_emg)
    table = feature_table(windows, plan, fs, cfg, has_emg)
    if materialise is not None:
        table = materialise(table)
    raw = table.select(REC, "window_index", *names)
    scaler = fit_scaler(raw, names, cfg.scaling)
    return Features(
        raw=raw,
        scaled=apply_scaler(raw, scaler, names, n_recordings),
        scaler=scaler,
        names=names,
        freqs=spectrum_grid(plan.size, fs, cfg.max_spectrum_hz),
        spectra=table.select(REC, "window_index", "power"),
        plan=plan,
    )
