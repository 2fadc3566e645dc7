"""Recording files as a Spark data source.

Every file is cut into sample ranges, one task each, so a recording that is larger than the
others does not end up in a single task. Paths must be readable by all executors.
"""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from statewave.config import InputConfig
from statewave.sources import arrays, edf
from statewave.sources.csv import read_csv
from statewave.sources.selectors import normalize_selector, resolve_channel

SCHEMA = "recording_id string, sample_idx bigint, eeg double, emg double"
SAMPLES_PER_TASK = 4_000_000
BATCH = 262_144
SUFFIXES = (".edf", ".csv", ".mat", ".npz", ".npy")


def expand(path: str) -> list[str]:
    found = sorted(glob.glob(path)) if any(c in path for c in "*?[") else [path]
    if not found:
        raise FileNotFoundError(path)
    return found


def recording_names(paths: list[str]) -> dict[str, str]:
    """Recording ids: paths below the folder that holds all files, so equal base names stay apart."""
    folder = os.path.commonpath([os.path.dirname(os.path.abspath(p)) for p in paths])
    return {p: os.path.relpath(os.path.abspath(p), folder).replace(os.sep, "/") for p in paths}


@dataclass
class SampleRange(InputPartition):
    path: str
    name: str
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(0)


@dataclass
class FileInfo:
    """What a file says about itself: rate, length in samples, channels."""

    path: str
    fs: float | None
    n: int
    eeg: int | str | None = None
    emg: int | str | None = None
    resampler: edf.Resampler | None = None


def inspect(path: str, options: dict) -> FileInfo:
    """Read the header only; length and rate follow from it."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".edf":
        head = edf.read_header(path)
        eeg = resolve_channel(head.labels, normalize_selector(options.get("eeg")), "eeg", True)
        emg = resolve_channel(head.labels, normalize_selector(options.get("emg")), "emg", False)
        n, fs, resampler = head.samples[eeg] * head.records, head.rate(eeg), None
        if emg is not None:
            n_emg = head.samples[emg] * head.records
            if abs(head.rate(emg) - fs) > 1e-6:
                resampler = edf.Resampler(int(round(fs)), int(round(head.rate(emg))))
                n_emg = resampler.length(n_emg)
            n = min(n, n_emg)
        return FileInfo(path, fs, n, eeg, emg, resampler)
    if suffix == ".npz":
        names, fs = arrays.npz_members(path)
        n = arrays.npz_length(path, "eeg")
        emg = "emg" if "emg" in names else None
        if emg is not None and arrays.npz_length(path, "emg") != n:
            raise ValueError("EEG and EMG must have the same length when both are provided.")
        return FileInfo(path, fs, n, "eeg", emg)
    if suffix == ".npy":
        return FileInfo(path, None, arrays.npy_length(path))
    if suffix == ".mat":
        x = arrays.read_mat(path, options.get("variable"))
        if x.ndim != 1:
            raise ValueError("EEG must be a one-dimensional array.")
        return FileInfo(path, None, len(x))
    raise ValueError(f"Unsupported input format: {suffix}")


def read_range(info: FileInfo, options: dict, first: int, last: int):
    """EEG and EMG values of a sample range."""
    suffix = os.path.splitext(info.path)[1].lower()
    if suffix == ".edf":
        head = edf.read_header(info.path)
        eeg = edf.read_samples(info.path, head, info.eeg, first, last)
        if info.emg is None:
            return eeg, None
        if info.resampler is None:
            return eeg, edf.read_samples(info.path, head, info.emg, first, last)
        a, b = info.resampler.needs(first, last)
        return eeg, info.resampler.outputs(
            edf.read_samples(info.path, head, info.emg, a, b), a, first, last)
    if suffix == ".npz":
        emg = None if info.emg is None else arrays.npz_slice(info.path, "emg", first, last)
        return arrays.npz_slice(info.path, "eeg", first, last), emg
    if suffix == ".npy":
        return arrays.npy_slice(info.path, first, last), None
    return arrays.read_mat(info.path, options.get("variable"))[first:last].astype(float), None


class RecordingSource(DataSource):
    """``spark.read.format("recording")`` with options path, eeg, emg, variable."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "RecordingReader":
        return RecordingReader(dict(self.options))


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[SampleRange]:
        step = int(self.options.get("samplespertask", SAMPLES_PER_TASK))
        out = []
        for path, name in recording_names(expand(self.options["path"])).items():
            n = inspect(path, self.options).n
            # level 4/5 MAT files cannot be cut: at most 2 GB by format, so one task each
            size = max(n, 1) if path.lower().endswith(".mat") else step
            out += [SampleRange(path, name, a, min(a + size, n)) for a in range(0, n, size)]
        return out

    def read(self, partition: SampleRange) -> Iterator[pa.RecordBatch]:
        info = inspect(partition.path, self.options)
        name = partition.name
        whole = partition.path.lower().endswith(".mat")
        step = partition.last - partition.first if whole else BATCH
        for a in range(partition.first, partition.last, max(step, 1)):
            b = min(a + step, partition.last)
            eeg, emg = read_range(info, self.options, a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]).take(pa.array(np.zeros(b - a, dtype=np.int32))),
                 pa.array(np.arange(a, b)), pa.array(np.asarray(eeg, dtype=float)),
                 pa.nulls(b - a, pa.float64()) if emg is None else pa.array(emg)],
                names=["recording_id", "sample_idx", "eeg", "emg"])


@dataclass
class Signal:
    """Recordings in long form plus what every stage needs to know about them."""

    samples: DataFrame  # recording_id, sample_idx, eeg, emg
    fs: float
    has_emg: bool

    def with_time(self) -> DataFrame:
        return self.samples.withColumn("time_sec", F.col("sample_idx") / F.lit(self.fs))


def load_signals(spark: SparkSession, path: str, fs: float | None = None,
                 config: InputConfig | None = None) -> Signal:
    """Load one file, or a glob of files of one format, as recordings of one sampling rate.

    A rate stored in the file wins over ``fs``.
    """
    cfg = config or InputConfig()
    paths = expand(str(path))
    suffixes = {os.path.splitext(p)[1].lower() for p in paths}
    for suffix in suffixes:
        if suffix not in SUFFIXES:
            raise ValueError(f"Unsupported input format: {suffix}")
    if len(suffixes) > 1:
        raise ValueError("All files of one run must have the same format.")
    if ".csv" in suffixes:
        samples = read_csv(spark, str(path), cfg)
        rates, has_emg = set(), dict(samples.dtypes)["emg"] == "double" and not samples.filter(
            F.col("emg").isNotNull()).isEmpty()
    else:
        options = {"eeg": cfg.eeg_channel, "emg": cfg.emg_channel, "variable": cfg.mat_variable}
        options = {k: str(v) for k, v in options.items() if v is not None}
        infos = [inspect(p, options) for p in paths]
        rates = {i.fs for i in infos if i.fs is not None}
        if len({i.emg is not None for i in infos}) > 1:
            raise ValueError("All files of one run need an EMG channel, or none.")
        has_emg = infos[0].emg is not None
        spark.dataSource.register(RecordingSource)
        samples = spark.read.format("recording").options(path=str(path), **options).load()
    if len(rates) > 1:
        raise ValueError(f"All files of one run must share a sampling rate, got {sorted(rates)}.")
    rate = rates.pop() if rates else fs
    if rate is None:
        raise ValueError("Sampling rate fs must be provided either in the file or as an argument.")
    return Signal(samples, float(rate), has_emg)
