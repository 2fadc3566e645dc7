"""Command line: ``python -m statewave``."""

from __future__ import annotations

import argparse
from pathlib import Path

from statewave.config import PipelineConfig
from statewave.plans.run import run_file_pipeline, run_pipeline
from statewave.session import get_spark
from statewave.sources.demo import synthetic_demo

# option, keyword arguments, where the value goes in the configuration
OPTIONS = [
    (["--output"], dict(default="sessions", help="output folder"), "output.output_dir"),
    (["--use-dask"], dict(action=argparse.BooleanOptionalAction, default=True,
                          help="accepted, has no effect"), "execution.use_dask"),
    (["--k-user", "--clusters"], dict(dest="k_user", type=int, default=3, help="number of clusters"),
     "execution.k_user clustering.n_clusters"),
    (["--window-size"], dict(type=int, help="window in samples"), "execution.window_size"),
    (["--overlap"], dict(type=int, help="overlap in samples"), "execution.overlap"),
    (["--window-strategy"], dict(default="seconds", choices=["seconds", "samples", "notebook_auto"]),
     "execution.window_strategy"),
    (["--window-sec"], dict(type=float, default=30.0), "windowing.window_sec"),
    (["--overlap-sec"], dict(type=float, default=0.0), "windowing.overlap_sec"),
    (["--seed"], dict(type=int, default=42), "clustering.random_seed"),
    (["--manifold"], dict(default="umap", choices=["umap", "diffusion", "pca"]), "manifold.method"),
    (["--feature-mode"], dict(default="full", choices=["full", "legacy"]), "features.mode"),
    (["--feature-scaling"], dict(default="zscore", choices=["zscore", "minmax"]), "features.scaling"),
    (["--acceleration-backend"], dict(default="auto", choices=["auto", "numpy", "torch"]),
     "acceleration.backend"),
    (["--device"], dict(default="auto", choices=["auto", "cpu", "cuda", "mps"]), "acceleration.device"),
    (["--min-windows-for-gpu"], dict(type=int, default=64), "acceleration.min_windows_for_gpu"),
    (["--eeg-channel"], dict(help="EDF channel name or number"), "input.eeg_channel"),
    (["--emg-channel"], dict(help="EDF channel name or number"), "input.emg_channel"),
    (["--mat-variable"], dict(), "input.mat_variable"),
    (["--csv-eeg-column"], dict(), "input.csv_eeg_column"),
    (["--csv-emg-column"], dict(), "input.csv_emg_column"),
    (["--csv-has-header"], dict(action=argparse.BooleanOptionalAction, default=None),
     "input.csv_has_header"),
    (["--csv-separator"], dict(), "input.csv_separator"),
    (["--input", "--filename"], dict(dest="filename", help="file or glob: .edf .csv .mat .npz .npy"),
     "input.filename"),
    (["--fs"], dict(type=float, help="sampling rate where the file has none"), ""),
    (["--demo"], dict(action="store_true", help="run on synthetic signals"), ""),
    (["--duration-sec"], dict(type=float, default=1800.0, help="length of the demo"), ""),
]


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(
        prog="statewave", description="Unsupervised state clustering and dynamics of biosignals.")
    for flags, kwargs, _ in OPTIONS:
        parser.add_argument(*flags, **kwargs)
    return parser


def config_from(args: argparse.Namespace) -> PipelineConfig:
    cfg = PipelineConfig()
    for flags, kwargs, targets in OPTIONS:
        value = getattr(args, kwargs.get("dest") or flags[-1].lstrip("-").replace("-", "_"))
        for target in targets.split():
            section, name = target.split(".")
            setattr(getattr(cfg, section), name, Path(value) if name == "output_dir" else value)
    return cfg


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    if not args.demo and not args.filename:
        raise SystemExit("Either --input or --demo must be provided.")
    cfg, spark = config_from(args), get_spark()
    if args.demo:
        signal = synthetic_demo(spark, args.fs or 128.0, args.duration_sec, args.seed)
        result = run_pipeline(signal, config=cfg, spark=spark)
    else:
        result = run_file_pipeline(args.filename, args.fs, cfg, spark)
    print(f"Analysis complete. Outputs saved to: {result.output_dir}")
