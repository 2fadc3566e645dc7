"""Unsupervised state discovery in biosignals, on Spark."""

from statewave.config import PipelineConfig
from statewave.operators.align import align_cluster_labels
from statewave.operators.explain import explain
from statewave.operators.features import extract_features
from statewave.operators.hmm import hmm_analysis
from statewave.operators.manifold import manifold
from statewave.plans.run import (
    build_compatible_config, run_file_pipeline, run_interactive, run_pipeline)
from statewave.plans.stages import cluster, preprocess, window_signals

__all__ = [
    "PipelineConfig",
    "align_cluster_labels",
    "build_compatible_config",
    "cluster",
    "explain",
    "extract_features",
    "hmm_analysis",
    "manifold",
    "preprocess",
    "run_file_pipeline",
    "run_interactive",
    "run_pipeline",
    "window_signals",
]
